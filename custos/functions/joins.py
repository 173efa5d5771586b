"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custos.session import cut_lineage

# Broadcast a dimension only while it holds at most this many rows.
BROADCAST_MAX_ROWS = 500_000
# A key with more child rows than this is hot: its rows are dealt to parts of about so many, at least ``SALTS`` of them.
HOT_ROWS = 1_000_000
SALTS = 16


def small_side(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``broadcast(df)`` when a count proves it small, else ``df`` unchanged (a
    normal shuffle join, still re-planned by AQE). The count is one cheap job
    over a dimension table, summed up from partial counts; the bound, not a
    guess, decides the strategy."""
    return F.broadcast(df) if df.count() <= max_rows else df


def to_many(one: DataFrame, many: DataFrame, key: str, how: str = "left", salts: int = SALTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join rows that are unique by ``key`` to any number of child rows each.

    Children are counted by key first (combined map-side). Keys up to ``hot_rows`` children are joined plainly, on
    whatever layout the parents have. The rows of a hotter key are dealt in turn to parts of about ``hot_rows``, by their position, not by
    what they hold, so that equal rows are spread too, and only the hot parents are repeated, once a part. There
    are at most rows / ``hot_rows`` hot keys, so a count bounds their broadcast. Positions are fixed by writing the hot rows
    before they are shuffled: a task that is run again deals them alike."""
    count = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = count.select(key, F.greatest(F.lit(salts), F.ceil(F.col("_n") / hot_rows)).cast("bigint").alias("_parts")).collect()
    if not hot:
        return one.join(many, key, how)
    kind = f"{key} {one.schema[key].dataType.simpleString()}, _parts bigint"
    hot = small_side(one.sparkSession.createDataFrame(hot, kind))
    keys = hot.select(key)
    dealt = cut_lineage(many.join(hot, key).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.col("_parts"))).drop("_parts"), "dealt")
    parent = one.join(hot, key).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")
    spread = parent.join(dealt, [key, "_salt"], "inner").drop("_salt")
    return one.join(keys, key, "left_anti").join(many.join(keys, key, "left_anti"), key, how).unionByName(spread)
