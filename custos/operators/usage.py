"""Usage statistics (S7, A17-A19) and the flat statistics table.

Time ranges are relative to an explicit ``as_of`` (default: the newest event
in the table, a scalar sub-query) - no wall clock inside a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custos.functions import fixed
from custos.operators.assets import clean_assets, schema_field_counts
from custos.operators.profile import profile_latest
from custos.sources.catalog import Catalog

UNAVAILABLE = "usage statistics are unavailable for this catalogue"


def _as_of(events: DataFrame, as_of) -> Column:
    if as_of is None:
        return events.select(F.max("ts")).scalar()
    return F.lit(as_of).cast("timestamp_ntz")


def usage_in_range(cat: Catalog, time_range: str = "MONTH", as_of=None) -> DataFrame:
    days = fixed.TIME_RANGE_DAYS[time_range.upper()]
    e = cat.usage_events
    end = _as_of(e, as_of)
    start = F.timestamp_add("DAY", F.lit(-days), end)
    return e.where((F.col("ts") > start) & (F.col("ts") <= end))


def usage_summary(cat: Catalog, time_range: str = "MONTH", as_of=None) -> DataFrame:
    """Per asset total queries and distinct users over the range.
    A missing usage table yields null totals plus a reason (profiles unaffected)."""
    if cat.usage_events is None:
        return clean_assets(cat).select(
            "asset_id", F.lit(time_range.upper()).alias("time_range"),
            F.lit(None).cast("bigint").alias("total_queries"),
            F.lit(None).cast("bigint").alias("unique_users"),
            F.lit(UNAVAILABLE).alias("usage_unavailable_reason"))
    u = usage_in_range(cat, time_range, as_of)
    return u.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_distinct("user_urn").alias("unique_users")).select(
        "asset_id", F.lit(time_range.upper()).alias("time_range"), "total_queries", "unique_users",
        F.lit(None).cast("string").alias("usage_unavailable_reason"))


def usage_top_users(cat: Catalog, k: int = 10, time_range: str = "MONTH", as_of=None) -> DataFrame:
    """The k heaviest users per asset (ties by user URN) - a top-k report;
    the row_number filter is planned as a map-side group limit."""
    u = usage_in_range(cat, time_range, as_of)
    per = u.groupBy("asset_id", "user_urn").agg(F.count(F.lit(1)).alias("query_count"))
    w = Window.partitionBy("asset_id").orderBy(F.desc("query_count"), "user_urn")
    return (per.withColumn("user_rank", F.row_number().over(w)).where(F.col("user_rank") <= k)
            .select("asset_id", "user_rank", "user_urn",
                    F.substring_index("user_urn", ":", -1).alias("username"), "query_count"))


def usage_buckets(cat: Catalog, time_range: str = "MONTH", as_of=None) -> DataFrame:
    """Per asset and day: queries and distinct users."""
    u = usage_in_range(cat, time_range, as_of)
    return u.groupBy("asset_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_distinct("user_urn").alias("unique_users")).select(
        "asset_id", F.date_format("day", "yyyy-MM-dd").alias("bucket"), "total_queries", "unique_users")


def usage_fields(cat: Catalog, time_range: str = "MONTH", as_of=None) -> DataFrame:
    """Per asset and field: how often it was used."""
    u = usage_in_range(cat, time_range, as_of)
    return u.where(F.col("field_name").isNotNull()).groupBy("asset_id", "field_name").agg(
        F.count(F.lit(1)).alias("count"))


def statistics_summary(cat: Catalog, time_range: str = "MONTH", as_of=None) -> DataFrame:
    """One flat row per asset; null stays distinct from zero."""
    a = clean_assets(cat).select("asset_id", "urn")
    latest = profile_latest(cat) if cat.profiles is not None else None
    usage = usage_summary(cat, time_range, as_of)
    out = a
    if latest is not None:
        out = out.join(latest, "asset_id", "left")
    else:
        out = (out.withColumn("profiled_at", F.lit(None).cast("string"))
               .withColumn("row_count", F.lit(None).cast("bigint"))
               .withColumn("size_in_bytes", F.lit(None).cast("bigint")))
    out = out.join(usage.drop("time_range"), "asset_id", "left")
    if cat.schema_fields is not None:
        out = out.join(schema_field_counts(cat).select("asset_id", F.col("field_count").alias("column_count")), "asset_id", "left")
    else:
        out = out.withColumn("column_count", F.lit(None).cast("bigint"))
    available = cat.usage_events is not None
    return out.select(
        "asset_id", "urn",
        F.col("profiled_at").isNotNull().alias("profiled"), "column_count",
        "row_count", "size_in_bytes", "profiled_at",
        F.lit(available).alias("usage_available"),
        (F.coalesce("total_queries", F.lit(0)) if available else F.col("total_queries")).alias("total_queries"),
        (F.coalesce("unique_users", F.lit(0)) if available else F.col("unique_users")).alias("unique_users"),
        F.lit(None if available else UNAVAILABLE).cast("string").alias("usage_unavailable_reason"),
        F.lit(time_range.upper()).alias("time_range"))
