"""Metadata change records (S8) and scan history.

* S8: change records ``(entity_urn, aspect, item, version, payload)``; an aspect that
  holds a list (owners, tags, schema fields) has one record per item, named by
  ``item``, so no item replaces another. The current state is the latest
  version per (entity, aspect, item) - an aggregate of
  ``max(struct(version, payload))`` that combines map-side, so a hot entity
  with millions of changes costs one partial row per task. Writing is an
  idempotent dynamic-partition overwrite by aspect.
* X1: findings persisted per scan date (dynamic overwrite: re-running a date
  replaces only that date).
* X2-X4: trend, new/resolved findings and schema drift between two scans.
* X5: stale assets relative to an explicit ``as_of``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custos.functions import columns as C
from custos.functions import fixed
from custos.functions.joins import to_many
from custos.operators.assets import clean_assets, schema_clean, tags_clean
from custos.sources.catalog import Catalog


# --- S8 -------------------------------------------------------------------------------

def aspect_events(cat: Catalog) -> DataFrame:
    """Change records derived from the catalogue tables: one properties record
    per asset (item ''), one ownership record per ownership entry (item: owner and
    type), one tags record per tag, one schema record per field (item: its path);
    version = position / change stamp."""
    a = clean_assets(cat)
    raw = cat.assets
    props = raw.select(
        C.clean_text("urn").alias("entity_urn"), F.lit("datasetProperties").alias("aspect"), F.lit("").alias("item"),
        F.coalesce(F.col("last_modified_ms").cast("bigint"), F.lit(0).cast("bigint")).alias("version"),
        C.json_of(C.clean_text("name").alias("name"),
                           F.coalesce(C.clean_text("editable_description"),
                                      C.clean_text("description")).alias("description"),
                           C.clean_text("platform").alias("platform")).alias("payload")
    ).where(F.col("entity_urn").isNotNull())
    urn_of = a.select("asset_id", "urn")
    own = to_many(urn_of, cat.ownership, "asset_id", "inner").select(
        F.col("urn").alias("entity_urn"), F.lit("ownership").alias("aspect"),
        F.concat_ws("|", "owner_urn", "ownership_type").alias("item"), F.col("pos").alias("version"),
        C.json_of("owner_urn", "ownership_type").alias("payload"))
    tags = to_many(urn_of, tags_clean(cat), "asset_id", "inner").select(
        F.col("urn").alias("entity_urn"), F.lit("globalTags").alias("aspect"), F.col("tag").alias("item"), F.lit(0).cast("bigint").alias("version"),
        C.json_of("tag").alias("payload"))
    fields = to_many(urn_of, schema_clean(cat), "asset_id", "inner").select(
        F.col("urn").alias("entity_urn"), F.lit("schemaMetadata").alias("aspect"), F.col("field_path").alias("item"), F.col("pos").cast("bigint").alias("version"),
        C.json_of("field_path", "native_data_type").alias("payload"))
    return reduce(DataFrame.unionByName, [props, own, tags, fields])


def latest_aspects(events: DataFrame) -> DataFrame:
    """Current value per (entity, aspect, item): highest version, ties by payload."""
    return events.groupBy("entity_urn", "aspect", "item").agg(
        F.max(F.struct("version", "payload")).alias("l"),
        F.count(F.lit(1)).alias("changes")).select(
        "entity_urn", "aspect", "item", F.col("l.version").alias("version"), F.col("l.payload").alias("payload"), "changes")


def upsert_aspects(events: DataFrame, path: str) -> None:
    """Write the latest aspects partitioned by aspect with dynamic partition
    overwrite: re-running with the same input rewrites the same partitions
    to the same content (idempotent)."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    latest_aspects(events).write.mode("overwrite").partitionBy("aspect").parquet(path)


# --- X1 ---------------------------------------------------------------------------------

def persist_findings(findings: DataFrame, path: str, scan_date: str) -> None:
    spark = findings.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    (findings.withColumn("scan_date", F.lit(scan_date))
     .write.mode("overwrite").partitionBy("scan_date").parquet(path))


# --- X2 / X3 -----------------------------------------------------------------------------

def findings_history(previous: DataFrame, current: DataFrame, prev_date: str, curr_date: str) -> DataFrame:
    return (previous.withColumn("scan_date", F.lit(prev_date))
            .unionByName(current.withColumn("scan_date", F.lit(curr_date))))


def risk_trend(history: DataFrame) -> DataFrame:
    """Findings by severity per scan date (all four levels as columns)."""
    return (history.groupBy("scan_date").pivot("severity", fixed.SEVERITY_LEVELS).count()
            .select("scan_date", *[F.coalesce(F.col(lv), F.lit(0)).cast("bigint").alias(lv)
                                   for lv in fixed.SEVERITY_LEVELS]))


def finding_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """New, resolved and persisting findings between two scans, keyed by (asset, rule)."""
    p = previous.select("asset_id", "rule", F.lit(True).alias("in_prev"))
    c = current.select("asset_id", "rule", F.lit(True).alias("in_curr"))
    j = p.join(c, ["asset_id", "rule"], "full_outer")
    status = (F.when(F.col("in_prev").isNull(), "new").when(F.col("in_curr").isNull(), "resolved")
              .otherwise("persisting"))
    return j.select("asset_id", "rule", status.alias("status"))


# --- X4 ------------------------------------------------------------------------------------

def schema_diff(cat: Catalog) -> DataFrame:
    """Added, removed and retyped columns between the previous and current schema."""
    prev = schema_clean(cat, "schema_fields_prev").select(
        "asset_id", "field_path", F.col("native_data_type").alias("prev_type"))
    curr = schema_clean(cat, "schema_fields").select(
        "asset_id", "field_path", F.col("native_data_type").alias("curr_type"))
    j = prev.join(curr, ["asset_id", "field_path"], "full_outer")
    change = (F.when(F.col("prev_type").isNull() & F.col("curr_type").isNotNull(), "added")
              .when(F.col("curr_type").isNull() & F.col("prev_type").isNotNull(), "removed")
              .when(~F.col("prev_type").eqNullSafe(F.col("curr_type")), "retyped"))
    return j.select("asset_id", "field_path", "prev_type", "curr_type", change.alias("change")).where(
        F.col("change").isNotNull())


def derived_schema_drift(cat: Catalog) -> DataFrame:
    """Per asset: drift derived from the two snapshots (any added/removed/retyped column)."""
    return schema_diff(cat).select("asset_id").distinct().withColumn("schema_drift", F.lit(True))


# --- X5 -------------------------------------------------------------------------------------

def stale_assets(cat: Catalog, limit_days: int = 30, as_of=None) -> DataFrame:
    """Assets whose last change is more than ``limit_days`` before ``as_of``
    (default: the newest change in the catalogue, a scalar sub-query)."""
    a = clean_assets(cat).withColumn("last_modified", F.coalesce("last_modified", "last_ingested"))
    end = (a.select(F.max("last_modified")).scalar() if as_of is None
           else F.lit(as_of).cast("timestamp_ntz"))
    days = F.datediff(F.to_date(end), F.to_date("last_modified"))
    return a.where(F.col("last_modified").isNotNull()).select(
        "asset_id", "urn", C.iso("last_modified").alias("last_modified"), days.alias("days_stale")).where(
        F.col("days_stale") > limit_days)
