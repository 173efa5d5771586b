"""Column profiles (A20) that are merged from profiles of single files.

A file of a table is profiled once, when it is new: for each column its rows and nulls, least, greatest, mean and sum of squared
deviations (numbers), lengths (texts), a HyperLogLog sketch of its values, a KLL sketch of its order (numbers) and a sketch of its most
frequent values. These rows are appended to a profile table; a table's profile is their merge, which reads no data. Files are known by
path and taken as immutable, as those of append-only tables are; a file that is gone is left out by naming the files that count.

Counts, extremes and means are exact. Distinct values have a relative standard error of 1.04 / sqrt(2 ** ``LG_K``) beyond a list of a few
hundred (0.8 %), quantiles a rank error of about 1.65 / ``KLL_K`` ** 0.9 (below 1 % with 99 % confidence), frequent values the error bounds
of a summary of ``TOP_ITEMS`` values. BIGINT columns keep their type in the quantile sketch. Exact figures are those of ``profile.column_profile``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custos.functions.tables import CommitLog

LG_K = 14
KLL_K = 200
TOP_ITEMS = 1024  # values a summary keeps; those of more than ``TOP_LENGTH`` characters aren't summed up
TOP_LENGTH = 64
_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REALS = (T.FloatType, T.DoubleType, T.DecimalType)
_KEY = ["table_name", "column_name", "pos", "kind"]


def _kind(t: T.DataType) -> str:
    return "integer" if isinstance(t, _INTS) else "real" if isinstance(t, _REALS) else "text" if isinstance(t, T.StringType) else "other"


def _values(i: int, f: T.StructField) -> list[Column]:
    """What the aggregates of one column read, named by its position: each is worked out once a row, in compiled code (a sketch
    evaluates its argument by itself, row by row)."""
    c, kind = F.col("`" + f.name.replace("`", "``") + "`"), _kind(f.dataType)
    number = c.cast("double") if kind in ("integer", "real") else F.length(c).cast("double") if kind == "text" else F.lit(None).cast("double")
    text = c.cast("string") if kind != "other" else F.to_json(F.struct(c))
    return [number.alias(f"x{i}"), F.when(c.isNotNull(), text).alias(f"t{i}"), *([c.cast("bigint").alias(f"i{i}")] if kind == "integer" else [])]


def _column(i: int, f: T.StructField) -> list[Column]:
    """The aggregates of one column, named by its position, over its ``_values``; ``s``: a text if it is short."""
    number, text, kind = F.col(f"x{i}"), F.col(f"t{i}"), _kind(f.dataType)
    none = F.max(F.lit(None).cast("binary"))
    return [F.count(text).alias(f"n{i}"), F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}"), F.avg(number).alias(f"av{i}"),
            (F.var_pop(number) * F.count(number)).alias(f"m2{i}"), F.hll_sketch_agg(text, LG_K).alias(f"ds{i}"),
            (F.kll_sketch_agg_bigint(F.col(f"i{i}"), KLL_K) if kind == "integer" else none).alias(f"ki{i}"),
            (F.kll_sketch_agg_double(number, KLL_K) if kind in ("real", "text") else none).alias(f"kr{i}"),
            F.call_function("approx_top_k_accumulate", F.col(f"s{i}"), F.lit(TOP_ITEMS)).alias(f"top{i}")]


def profile_files(df: DataFrame, table_name: str) -> DataFrame:
    """One row for each file of ``df`` (a plain read of files) and column. One pass over the data; a file's rows meet as partial
    aggregates only."""
    fields = df.schema.fields
    values = df.select(F.col("_metadata.file_path").alias("_file"), *[v for i, f in enumerate(fields) for v in _values(i, f)])
    # the text of a number is always short
    values = values.select("*", *[(F.col(f"t{i}") if _kind(f.dataType) in ("integer", "real") else F.when(F.length(f"t{i}") <= TOP_LENGTH, F.col(f"t{i}"))).alias(f"s{i}")
                                  for i, f in enumerate(fields)])
    wide = values.groupBy("_file").agg(
        F.count(F.lit(1)).alias("_rows"), *[a for i, f in enumerate(fields) for a in _column(i, f)])
    rows = F.array(*[F.struct(
        F.lit(f.name).alias("column_name"), F.lit(i + 1).alias("pos"), F.lit(_kind(f.dataType)).alias("kind"), F.col(f"n{i}").alias("n"),
        F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), F.col(f"av{i}").alias("mean"), F.col(f"m2{i}").alias("m2"),
        F.col(f"ds{i}").alias("distinct"), F.col(f"ki{i}").alias("ints"), F.col(f"kr{i}").alias("reals"), F.col(f"top{i}").alias("top"))
        for i, f in enumerate(fields)])
    return wide.select(F.lit(table_name).alias("table_name"), F.col("_file").alias("file"), F.col("_rows").alias("rows"), F.explode(rows).alias("x")).select(
        "table_name", "file", "rows", "x.*")


def merge(profiles: DataFrame, top: int = 5) -> DataFrame:
    """One row for each table and column from rows of ``profile_files``; text columns have the figures of their lengths."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))
    both = profiles.groupBy(*_KEY).agg(
        F.sum("rows").alias("row_count"), (F.sum("rows") - n).alias("null_count"), n.alias("n"), F.min("lo").alias("min"), F.max("hi").alias("max"),
        mean.alias("mean"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_count"),
        F.kll_merge_agg_bigint("ints").alias("_ints"), F.kll_merge_agg_double("reals").alias("_reals"),
        F.call_function("approx_top_k_combine", F.col("top"), F.lit(TOP_ITEMS)).alias("_top"))
    # squared deviations from the common mean: those inside the files and those of the files' means
    spread = profiles.join(both.select("table_name", "column_name", F.col("mean").alias("_mean")), ["table_name", "column_name"]).groupBy(
        "table_name", "column_name").agg(F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2).alias("_m2"))
    at = lambda q: F.when(F.col("n") == 0, None).when(F.col("kind") == "integer", F.kll_sketch_get_quantile_bigint("_ints", F.lit(q)).cast("double")).when(
        F.col("kind").isin("real", "text"), F.kll_sketch_get_quantile_double("_reals", F.lit(q)))
    return both.join(spread, ["table_name", "column_name"]).select(
        *_KEY, "row_count", "null_count", "distinct_count", "min", "max", "mean", at(0.25).alias("q25"), at(0.5).alias("median"), at(0.75).alias("q75"),
        F.when(F.col("n") > 1, F.sqrt(F.col("_m2") / (F.col("n") - 1))).alias("stdev"),
        F.when(F.col("n") > 0, F.call_function("approx_top_k_estimate", F.col("_top"), F.lit(top))).alias("frequent"))


class ProfileTable:
    """Profiles of files under ``root``; folders count when their commit is there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), CommitLog(spark, root)

    def rows(self) -> DataFrame | None:
        folders = (self.log.newest() or {"folders": []})["folders"]
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders]) if folders else None

    def update(self, table_name: str, files: list[str], kind: str = "parquet") -> list[str]:
        """Profile those of ``files`` that have no profile yet; returns them. Nothing else is read."""
        have = self.rows()
        old = set() if have is None else {r[0] for r in have.where(F.col("table_name") == table_name).select("file").distinct().collect()}  # a row a file
        plain = lambda p: "/" + p.split(":", 1)[-1].lstrip("/")  # noqa: E731  file:/x and file:///x are one
        old = {plain(p) for p in old}
        new = [f for f in files if plain(f) not in old]
        if new:
            state = self.log.newest() or {"number": 0, "folders": []}
            folder = f"{state['number'] + 1:08d}-{uuid.uuid4().hex[:8]}"
            profile_files(self.spark.read.format(kind).load(new), table_name).write.parquet(f"{self.root}/{folder}")
            self.log.commit({"number": state["number"] + 1, "folders": [*state["folders"], folder]})
        return new

    def profile(self, table_name: str | None = None) -> DataFrame:
        rows = self.rows()
        return merge(rows if table_name is None else rows.where(F.col("table_name") == table_name))
