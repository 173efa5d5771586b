"""Column profiling (A20) and profile snapshots.

The column profile is two passes over the table:

1. one wide aggregate: per column non-null count, typed min / max (rendered as
   text, since a column's extremes need not be numeric), mean and sample
   standard deviation for numeric columns - partial per partition, one merge;
2. one long pass: every cell becomes ``(column, value)``; ``groupBy`` with
   map-side combine yields each column's distinct values with multiplicity.
   That single table gives exact distinct counts and, by distributed
   selection, exact medians.

The exact median never gathers a column in one task: the distinct
(value, multiplicity) rows are range-partitioned, each partition reports its
row total (one row per partition and column, a bounded broadcast), running
offsets place the two middle ranks in one partition, and a window inside that
partition finds them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custos.functions import columns as C
from custos.session import cut_lineage
from custos.sources.catalog import Catalog

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def _as_text(c: str, dtype) -> "F.Column":
    col = F.col(c)
    if isinstance(dtype, T.TimestampNTZType):
        return C.wall_clock(col)
    if isinstance(dtype, T.TimestampType):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    return col.cast("string")


def exact_medians(long_num: DataFrame, partitions: int | None = None, counted: bool = False) -> DataFrame:
    """``long_num``: (column_name, v double) non-null cells -> (column_name, median);
    with ``counted`` the input is already (column_name, v, c) distinct values
    with multiplicity.

    Interpolated median (mean of the two middle values for an even count),
    computed by distributed selection over distinct values."""
    spark = long_num.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dv = (long_num.select("column_name", "v", "c") if counted
          else long_num.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("c")))
    # range bounds are sampled at each execution: both uses below must see one partitioning
    ranged = cut_lineage(dv.repartitionByRange(partitions, "column_name", "v").withColumn(
        "pid", F.spark_partition_id()), "ranged")
    summary = ranged.groupBy("column_name", "pid").agg(F.sum("c").alias("pc"))
    w = Window.partitionBy("column_name").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    wn = Window.partitionBy("column_name")
    summary = summary.select(
        "column_name", "pid", "pc",
        F.coalesce(F.sum("pc").over(w), F.lit(0)).alias("offset"),
        F.sum("pc").over(wn).alias("n"))
    summary = summary.select(
        "*", F.floor((F.col("n") - 1) / 2).alias("k1"), F.ceil((F.col("n") - 1) / 2).alias("k2"))
    # keep only the partitions holding a middle rank (at most two per column)
    holds = ((F.col("k1") >= F.col("offset")) & (F.col("k1") < F.col("offset") + F.col("pc"))) | \
            ((F.col("k2") >= F.col("offset")) & (F.col("k2") < F.col("offset") + F.col("pc")))
    targets = summary.where(holds).select("column_name", "pid", "offset", "k1", "k2")
    cand = ranged.join(F.broadcast(targets), ["column_name", "pid"], "inner")
    wr = Window.partitionBy("column_name", "pid").orderBy("v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cand = cand.select("*", (F.col("offset") + F.sum("c").over(wr) - F.col("c")).alias("before"))
    covers = lambda k: (F.col(k) >= F.col("before")) & (F.col(k) < F.col("before") + F.col("c"))
    picked = cand.groupBy("column_name").agg(
        F.max(F.when(covers("k1"), F.col("v"))).alias("v1"),
        F.max(F.when(covers("k2"), F.col("v"))).alias("v2"))
    return picked.select("column_name", ((F.col("v1") + F.col("v2")) / 2).alias("median"))


def column_profile(df: DataFrame, table_name: str, digits: int = 4) -> DataFrame:
    """One row per column: row/column count, null and unique counts and
    proportions, min, max (text), mean, median, stdev (numeric columns)."""
    fields = [(f.name, f.dataType) for f in df.schema.fields]
    numeric = [n for n, t in fields if isinstance(t, _NUMERIC)]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, (n, t) in enumerate(fields):
        aggs += [F.count(F.col(n)).alias(f"nn{i}"),
                 F.min(F.col(n)).alias(f"mn{i}"), F.max(F.col(n)).alias(f"mx{i}")]
        if n in numeric:
            aggs += [F.avg(F.col(n).cast("double")).alias(f"av{i}"),
                     F.stddev_samp(F.col(n).cast("double")).alias(f"sd{i}")]
    wide = df.agg(*aggs)
    rows = []
    for i, (n, t) in enumerate(fields):
        is_num = n in numeric
        rows.append(F.struct(
            F.lit(i + 1).alias("pos"), F.lit(n).alias("column_name"),
            F.col(f"nn{i}").alias("non_null"),
            _text_of(f"mn{i}", t).alias("min"), _text_of(f"mx{i}", t).alias("max"),
            (F.col(f"av{i}") if is_num else F.lit(None).cast("double")).alias("mean"),
            (F.col(f"sd{i}") if is_num else F.lit(None).cast("double")).alias("stdev")))
    per_col = wide.select("__rows", F.explode(F.array(*rows)).alias("x")).select("__rows", "x.*")

    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("column_name"), _as_text(n, t).alias("value"),
                 (F.col(n).cast("double") if n in numeric else F.lit(None).cast("double")).alias("v"))
        for n, t in fields])).alias("x")).select("x.*").where(F.col("value").isNotNull())
    # one distinct-values table (map-side combined) feeds both the exact distinct
    # counts and the exact medians
    dv = cells.groupBy("column_name", "value", "v").agg(F.count(F.lit(1)).alias("c"))
    distinct = dv.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))
    medians = exact_medians(dv.where(F.col("v").isNotNull()), counted=True)

    out = (per_col.join(distinct, "column_name", "left").join(medians, "column_name", "left"))
    rows_ = F.col("__rows")
    nn = F.col("non_null")
    return out.select(
        F.lit(table_name).alias("table_name"), "pos", "column_name",
        rows_.alias("row_count"), F.lit(len(fields)).alias("column_count"),
        (rows_ - nn).alias("null_count"),
        F.when(rows_ > 0, (rows_ - nn) / rows_).alias("null_proportion"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        F.when(nn > 0, F.coalesce("unique_count", F.lit(0)) / nn).alias("unique_proportion"),
        "min", "max",
        F.round("mean", digits).alias("mean"), F.col("median"),
        F.round("stdev", digits).alias("stdev"))


def _text_of(c: str, dtype) -> "F.Column":
    return _as_text(c, dtype)


def profile_tables(spark, sf_dir: str, tables=("customer", "orders", "lineitem")) -> DataFrame:
    """A20 over the given test tables, one long frame."""
    frames = [column_profile(spark.read.parquet(f"{sf_dir}/{t}.parquet"), t) for t in tables]
    return reduce(DataFrame.unionByName, frames)


# --- S6 / W2: profile snapshots -------------------------------------------------------

def profile_history(cat: Catalog, limit: int = 10) -> DataFrame:
    """Newest-first history per asset, null timestamps last, at most ``limit``
    (min 1) snapshots - a row_number filter, planned as a map-side group limit."""
    limit = max(1, int(limit))
    w = Window.partitionBy("asset_id").orderBy(F.col("profiled_at").desc_nulls_last(),
                                               F.col("row_count").desc(), F.col("size_in_bytes").desc())
    p = cat.profiles.select("asset_id", "profiled_at", "row_count", "size_in_bytes")
    return (p.withColumn("snapshot", F.row_number().over(w)).where(F.col("snapshot") <= limit)
            .select("asset_id", "snapshot", C.iso("profiled_at").alias("profiled_at"),
                    "row_count", "size_in_bytes"))


def profile_latest(cat: Catalog) -> DataFrame:
    """The latest snapshot per asset, as an aggregate (max of a struct ordered
    by timestamp with nulls lowest) - combined map-side, so a hot asset is cheap."""
    p = cat.profiles
    key = F.struct(F.col("profiled_at").isNotNull().alias("has_ts"), "profiled_at",
                   "row_count", "size_in_bytes")
    return p.groupBy("asset_id").agg(F.max(key).alias("l")).select(
        "asset_id", C.iso("l.profiled_at").alias("profiled_at"),
        F.col("l.row_count").alias("row_count"), F.col("l.size_in_bytes").alias("size_in_bytes"))


def profile_fields(raw_profiles: DataFrame) -> DataFrame:
    """Flatten nested profile documents (timestampMillis, rowCount, ...,
    fieldProfiles[]) into one row per snapshot and field statistic; field
    entries with no path are dropped, numbers coerced leniently."""
    snap = raw_profiles.select(
        C.clean_text("urn").alias("urn"),
        C.ts_from_millis(F.col("timestampMillis")).alias("profiled_at"),
        C.to_int(F.col("rowCount")).alias("row_count"),
        C.to_int(F.col("columnCount")).alias("column_count"),
        C.to_int(F.col("sizeInBytes")).alias("size_in_bytes"),
        F.explode_outer("fieldProfiles").alias("f"))
    return snap.select(
        "urn", C.iso("profiled_at").alias("profiled_at"), "row_count", "column_count", "size_in_bytes",
        C.clean_text(F.col("f.fieldPath")).alias("field_path"),
        C.to_int(F.col("f.uniqueCount")).alias("unique_count"),
        C.to_float(F.col("f.uniqueProportion")).alias("unique_proportion"),
        C.to_int(F.col("f.nullCount")).alias("null_count"),
        C.to_float(F.col("f.nullProportion")).alias("null_proportion"),
        C.clean_text(F.col("f.min")).alias("min"), C.clean_text(F.col("f.max")).alias("max"),
        C.clean_text(F.col("f.mean")).alias("mean"), C.clean_text(F.col("f.median")).alias("median"),
        C.clean_text(F.col("f.stdev")).alias("stdev"))
