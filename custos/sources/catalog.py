"""The catalogue: one DataFrame per metadata table.

Tables (long, one row per fact; nothing nested that can grow without bound):

* ``assets``            asset_id, urn, platform, name, description, editable_description,
                        deprecated, domain_urn, schema_drift, last_modified_ms
* ``domains``           domain_urn, name
* ``principals``        owner_urn, display_name, editable_display_name, active
* ``ownership``         asset_id, pos, owner_urn, ownership_type
* ``asset_tags``        asset_id, tag
* ``schema_fields``     asset_id, pos, field_path, native_data_type
* ``schema_fields_prev`` same, previous scan
* ``lineage_edges``     src, dst (asset ids)
* ``profiles``          asset_id, profiled_at, row_count, size_in_bytes
* ``usage_events``      asset_id, user_urn, ts, field_name
* ``questions``         question_id, question
* ``run_trace``         run_id, seq, node, status, duration_ms
* ``activity_events``   event_id, ts, kind, title
* ``glossary_terms``    asset_id, pos, term_urn, name, description
* ``links``             asset_id, pos, url, description
* ``custom_properties`` asset_id, pos, key, value
* ``primary_keys``      asset_id, pos, field_path
* ``tags``              tag_urn, name, description, color_hex (the vocabulary, used or not)
* ``domain_owners``     domain_urn, pos, owner_urn, ownership_type

Optional columns: ``assets`` created_ms, deprecation_note, decommission_ms; ``schema_fields`` label, type, nullable,
is_part_of_key; ``domains`` id, description; ``principals`` email, editable_email, title.

``Catalog.from_testdata`` derives all of them from the TPC-H-style test tables
with a fixed deterministic rule (the modulo expressions pick synthetic
attributes, e.g. which line items stand for ownership records); every derived
table grows linearly with its source table.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("assets", "domains", "principals", "ownership", "asset_tags", "schema_fields",
          "schema_fields_prev", "lineage_edges", "profiles", "usage_events", "questions",
          "run_trace", "activity_events", "glossary_terms", "links", "custom_properties", "primary_keys", "tags", "domain_owners")

# FIXED VALUES: platform per p_size % 5, in residue order 0..4.
PLATFORMS = ["snowflake", "postgres", "kafka", "dbt", "looker"]
# FIXED VALUES: second schema column per p_partkey % 4, in residue order 0..3.
SECOND_FIELDS = ["customer_email", "emailer_job_id", "created_at", "date_of_birth"]


@dataclass(frozen=True)
class Catalog:
    assets: DataFrame
    domains: DataFrame
    principals: DataFrame
    ownership: DataFrame
    asset_tags: DataFrame
    schema_fields: DataFrame
    schema_fields_prev: DataFrame | None = None
    lineage_edges: DataFrame | None = None
    profiles: DataFrame | None = None
    usage_events: DataFrame | None = None
    questions: DataFrame | None = None
    run_trace: DataFrame | None = None
    activity_events: DataFrame | None = None
    glossary_terms: DataFrame | None = None
    links: DataFrame | None = None
    custom_properties: DataFrame | None = None
    primary_keys: DataFrame | None = None
    tags: DataFrame | None = None
    domain_owners: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.assets.sparkSession

    def with_tables(self, **tables: DataFrame) -> "Catalog":
        return replace(self, **tables)

    def table_names(self) -> list[str]:
        return [f.name for f in fields(self) if getattr(self, f.name) is not None]

    # -- constructors -------------------------------------------------------------

    @classmethod
    def from_tables(cls, **tables: DataFrame) -> "Catalog":
        return cls(**tables)

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "Catalog":
        """A catalogue stored as one Parquet folder per table (missing -> None)."""
        loaded = {}
        for name in TABLES:
            path = f"{root.rstrip('/')}/{name}"
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
            loaded[name] = spark.read.parquet(path) if there else None
        return cls(**loaded)

    def write_parquet(self, root: str, mode: str = "overwrite") -> None:
        for name in self.table_names():
            getattr(self, name).write.mode(mode).parquet(os.path.join(root, name))

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, materialize: bool = True) -> "Catalog":
        """The derived catalogue; by default one a session and scale factor, whose
        tables are prepared when they are first used (see ``DerivedCatalog``)."""
        if not materialize:
            return derive_catalog(spark, sf_dir)
        key = (spark.sparkContext.applicationId, id(spark), os.path.abspath(sf_dir))
        cat = _MATERIALIZED.get(key)
        if cat is None:
            cat = DerivedCatalog(derive_catalog(spark, sf_dir))
            _MATERIALIZED[key] = cat
        return cat

    def materialize(self, partitions: int | None = None, root: str | None = None) -> "Catalog":
        """Write every table once as Parquet under the cluster's shared
        ``spark.checkpoint.dir`` (or ``root``) and read it back, so all later
        jobs start from columnar, lineage-free inputs (column pruning and
        pushed filters reach these scans).

        ``assets`` (one row per asset) is a bucketed table on ``asset_id``:
        every per-asset aggregate's single exchange on ``asset_id`` lines up
        with the buckets, so the fact joins need no shuffle on the asset side.
        Child tables and edges are written round-robin instead: a hot asset or
        hub node holding a third of a table is spread over all tasks, combined
        map-side before any shuffle, and joins on hot keys stay eligible for
        AQE's skew-join splitting."""
        # the tables are independent: submit their write jobs concurrently
        from concurrent.futures import ThreadPoolExecutor

        tag = uuid.uuid4().hex[:12]
        names = self.table_names()
        with ThreadPoolExecutor(max_workers=4) as pool:
            out = dict(zip(names, pool.map(lambda name: self._written(name, tag, partitions, root), names), strict=True))
        return replace(self, **out)

    def _written(self, name: str, tag: str, partitions: int | None = None, root: str | None = None) -> DataFrame:
        """One table, written as ``materialize`` says and read back."""
        from custos.session import ensure_checkpoint_dir

        spark, df = self.spark, getattr(self, name)
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{(root or ensure_checkpoint_dir(spark)).rstrip('/')}/custos-catalog-{tag}/{name}"
        if name == "assets":
            table = f"custos_{tag}_{name}"
            (df.repartition(n, "asset_id").write.mode("overwrite").bucketBy(n, "asset_id")
             .sortBy("asset_id").option("path", path).format("parquet").saveAsTable(table))
            return spark.table(table)
        df.repartition(n).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


# Derived tables that take a shuffle (or, ``assets``, that are laid out by key); all others are plain selections of one source table.
WRITTEN = ("assets", "domains", "tags", "lineage_edges", "profiles")


class DerivedCatalog(Catalog):
    """A derived catalogue, each table of which is prepared when it is first used: those in ``WRITTEN`` are written once (as
    ``materialize`` does), the others are read from their source table. So a query pays for the tables it reads alone,
    and no table is copied that its source holds already. ``with_tables`` gives a catalogue that shares what was prepared."""

    def __init__(self, derived: Catalog, prepared: dict[str, DataFrame] | None = None, given: dict[str, DataFrame] | None = None):
        for name, value in (("_derived", derived), ("_tag", uuid.uuid4().hex[:12]), ("_given", given or {}),
                            ("_prepared", {} if prepared is None else prepared)):
            object.__setattr__(self, name, value)

    def __getattribute__(self, name: str):
        if name not in TABLES:
            return object.__getattribute__(self, name)
        if name in self._given:
            return self._given[name]
        if name not in self._prepared:
            self._prepared[name] = self._derived._written(name, self._tag) if name in WRITTEN else getattr(self._derived, name)
        return self._prepared[name]

    @property
    def spark(self) -> SparkSession:
        return self._derived.spark

    def with_tables(self, **tables: DataFrame) -> Catalog:
        return DerivedCatalog(self._derived, self._prepared, self._given | tables)

    def table_names(self) -> list[str]:
        return [n for n in TABLES if n in self._given or getattr(self._derived, n) is not None]


_MATERIALIZED: dict = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_residue(value, labels: list[str]):
    expr = None
    for i, label in enumerate(labels):
        expr = F.when(value == i, label) if expr is None else expr.when(value == i, label)
    return expr


def _owner_urn(key):
    return F.concat(F.when(key % 3 == 0, F.lit("urn:li:corpGroup:"))
                    .otherwise(F.lit("urn:li:corpuser:")), key.cast("string"))


def derive_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    part = _read(spark, sf_dir, "part")
    supplier = _read(spark, sf_dir, "supplier")
    lineitem = _read(spark, sf_dir, "lineitem")
    events = _read(spark, sf_dir, "events")

    pk = F.col("p_partkey")
    platform = _by_residue(F.col("p_size") % 5, PLATFORMS)
    under = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), pk.cast("string"))
    domain_of_brand = F.concat(F.lit("urn:li:domain:"),
                               F.lower(F.regexp_replace("p_brand", "#", "_")))
    assets = part.select(
        pk.alias("asset_id"),
        F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:"), platform, F.lit(","),
                 F.lower("p_type"), F.lit("."), under, F.lit(",PROD)")).alias("urn"),
        platform.alias("platform"),
        F.when(pk % 23 != 0, under).alias("name"),
        F.when(pk % 4 == 1, F.lit("   "))
         .when(pk % 4 >= 2, F.concat(F.lit("  Part "), "p_name", F.lit("  "))).alias("description"),
        F.when(pk % 5 == 0, F.concat(F.lit("Curated "), "p_name")).alias("editable_description"),
        F.when(F.col("p_size") % 13 != 0, F.col("p_size") % 11 == 0).alias("deprecated"),
        F.when(pk % 9 != 0, domain_of_brand).alias("domain_urn"),
        F.when(pk % 17 == 0, True).when(pk % 17 == 1, False).alias("schema_drift"),
        F.when(pk % 6 == 0, F.lit(0).cast("bigint"))
         .otherwise(F.lit(1704067200000) + pk * 3600000).alias("last_modified_ms"),
        F.when(pk % 7 != 0, F.lit(1704067200000) + pk * 7200000).alias("last_ingested_ms"),
        F.when(pk % 10 != 0, F.concat(F.lower("p_type"), F.lit("."), under)).alias("qualified_name"),
        F.when(pk % 3 == 0, F.concat(F.lit("https://catalogue.example/"), pk.cast("string"))).alias("external_url"),
        F.when(F.col("p_size") % 2 == 0, "Table").otherwise("View").alias("sub_types"),
        F.when(pk % 12 != 5, F.lit(1672531200000) + pk * 60000).alias("created_ms"),
        F.when(pk % 2 == 0, F.concat(F.lit(" Use "), "p_brand", F.lit(" "))).alias("deprecation_note"),
        F.when(pk % 3 == 0, F.lit(1735689600000) + pk * 1000).alias("decommission_ms"),
    )

    fixed_domains = spark.createDataFrame(
        [("urn:li:domain:empty", "Empty", None, " "), ("urn:li:domain:unnamed", None, "unnamed", None)],
        "domain_urn string, name string, id string, description string")
    domains = (part.select(domain_of_brand.alias("domain_urn"), F.col("p_brand").alias("name"), F.lower("p_brand").alias("id"),
                           F.concat(F.lit("Parts of "), "p_brand").alias("description"))
               .distinct().unionByName(fixed_domains))

    sk = F.col("s_suppkey")
    principals = supplier.where(sk % 10 != 9).select(
        _owner_urn(sk).alias("owner_urn"),
        F.col("s_name").alias("display_name"),
        F.when(sk % 4 == 0, F.concat(F.lit("Team "), "s_name")).alias("editable_display_name"),
        (F.col("s_acctbal") > 0).alias("active"),
        F.when(sk % 2 == 0, F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))).alias("email"),
        F.when(sk % 6 == 0, F.concat(F.lit("team"), sk.cast("string"), F.lit("@example.com"))).alias("editable_email"),
        F.when(sk % 3 == 1, F.lit("Data steward")).alias("title"),
    )
    domain_owners = supplier.select(
        F.concat(F.lit("urn:li:domain:brand_"), (sk % 25 + 1).cast("string")).alias("domain_urn"), sk.alias("pos"),
        _owner_urn(sk % 50).alias("owner_urn"), F.when(sk % 2 == 0, "TECHNICAL_OWNER").otherwise("BUSINESS_OWNER").alias("ownership_type"))

    ownership = lineitem.select(
        F.col("l_partkey").alias("asset_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        _owner_urn(F.col("l_suppkey")).alias("owner_urn"),
        F.when(F.col("l_returnflag") == "R", "TECHNICAL_OWNER")
         .otherwise("BUSINESS_OWNER").alias("ownership_type"),
    )

    asset_tags = (part.where(F.col("p_size") % 5 == 0).select(pk.alias("asset_id"), F.lit("tier-1").alias("tag"))
                  .unionByName(part.where(F.col("p_size") % 7 == 0).select(pk.alias("asset_id"), F.lit("PII").alias("tag")))
                  .unionByName(part.where(F.col("p_size") % 3 == 0).select(pk.alias("asset_id"), F.lit("certified").alias("tag"))))

    none = F.lit(None).cast("string")
    schema_fields = (part.select(pk.alias("asset_id"), F.lit(1).alias("pos"), F.lit("id").alias("field_path"),
                                 F.lit("BIGINT").alias("native_data_type"), F.lit("Identifier").alias("label"),
                                 F.lit("NUMBER").alias("type"), F.lit(False).alias("nullable"), F.lit(True).alias("is_part_of_key"))
                     .unionByName(part.select(pk.alias("asset_id"), F.lit(2).alias("pos"),
                                              _by_residue(pk % 4, SECOND_FIELDS).alias("field_path"),
                                              F.lit("VARCHAR").alias("native_data_type"), none.alias("label"), F.lit("STRING").alias("type"),
                                              F.when(pk % 5 != 0, True).alias("nullable"), F.lit(None).cast("boolean").alias("is_part_of_key"))))
    primary_keys = part.where(pk % 7 != 0).select(pk.alias("asset_id"), F.lit(1).alias("pos"), F.lit("id").alias("field_path"))
    term = F.concat(F.lit("urn:li:glossaryTerm:"), F.lower("p_type"))
    glossary_terms = (part.select(pk.alias("asset_id"), F.lit(1).alias("pos"), term.alias("term_urn"), F.when(pk % 4 != 0, F.col("p_type")).alias("name"),
                                  F.concat(F.lit("Parts of type "), "p_type").alias("description"))
                      .unionByName(part.where(F.col("p_size") % 7 == 0).select(
                          pk.alias("asset_id"), F.lit(2).alias("pos"), F.when(pk % 9 != 0, "urn:li:glossaryTerm:personal").alias("term_urn"),
                          F.lit("Personal").alias("name"), none.alias("description"))))
    links = part.select(pk.alias("asset_id"), F.explode(F.array(
        F.struct(F.lit(1).alias("pos"), F.when(pk % 3 != 0, F.concat(F.lit(" https://wiki.example/"), pk.cast("string"))).alias("url"), F.col("p_name").alias("description")),
        F.struct(F.lit(2).alias("pos"), F.when(pk % 5 == 0, F.lit("https://runbook.example/")).otherwise("  ").alias("url"), none.alias("description")))).alias("l")).select("asset_id", "l.*")
    custom_properties = part.select(pk.alias("asset_id"), F.explode(F.array(
        F.struct(F.lit(1).alias("pos"), F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value")),
        F.struct(F.lit(2).alias("pos"), F.when(pk % 13 != 0, "brand").otherwise(" ").alias("key"), F.col("p_brand").alias("value")),
        F.struct(F.lit(3).alias("pos"), F.when(pk % 10 == 0, " size ").otherwise("note").alias("key"), none.alias("value")))).alias("p")).select("asset_id", "p.*")
    fixed_tags = spark.createDataFrame(
        [("urn:li:tag:tier-1", "Tier 1", "Most important", "#ff0000"), ("urn:li:tag:PII", None, "Personal data", None), ("urn:li:tag:legacy", "Legacy", " ", "#cccccc")],
        "tag_urn string, name string, description string, color_hex string")
    tags = fixed_tags.unionByName(part.select(F.concat(F.lit("urn:li:tag:"), F.lower("p_brand")).alias("tag_urn"), F.col("p_brand").alias("name"),
                                              none.alias("description"), none.alias("color_hex")).distinct())
    schema_fields_prev = (
        part.select(pk.alias("asset_id"), F.lit(1).alias("pos"), F.lit("id").alias("field_path"),
                    F.when(pk % 8 == 0, "INT").otherwise("BIGINT").alias("native_data_type"))
        .unionByName(part.where(pk % 10 == 0).select(
            pk.alias("asset_id"), F.lit(2).alias("pos"), F.lit("legacy_code").alias("field_path"),
            F.lit("VARCHAR").alias("native_data_type"))))

    # pairs whose target lies outside the parts' keys go before anything is shuffled, repeats before the join
    least, most = (part.select(f("p_partkey")).scalar() for f in (F.min, F.max))
    target = (F.col("l_partkey") * 2 + F.col("l_linenumber") * 13).cast(part.schema["p_partkey"].dataType)
    pairs = lineitem.select(F.col("l_partkey").alias("src"), target.alias("dst")).where((F.col("dst") >= least) & (F.col("dst") <= most)).distinct()
    lineage_edges = pairs.join(part.select(pk.alias("dst")).hint("merge"), "dst", "left_semi").select("src", "dst")

    profiles = (lineitem.groupBy("l_partkey", F.year("l_shipdate").alias("yr"))
                .agg(F.max("l_shipdate").alias("profiled_at"),
                     F.count(F.lit(1)).alias("row_count"),
                     F.sum("l_quantity").cast("bigint").alias("size_in_bytes"))
                .select(F.col("l_partkey").alias("asset_id"), "profiled_at", "row_count",
                        "size_in_bytes"))

    n_assets = part.select(F.count(F.lit(1))).scalar()
    usage_events = events.select(
        (F.col("event_id") % n_assets).alias("asset_id"),
        F.concat(F.lit("urn:li:corpuser:"), F.col("user_id").cast("string")).alias("user_urn"),
        F.col("ts"),
        F.col("event_type").alias("field_name"),
    )

    et = F.col("event_type")
    uid = F.col("user_id").cast("string")
    questions = events.select(
        F.col("event_id").alias("question_id"),
        F.when(et == "error", "Which datasets are highest risk?")
         .when(et == "click", "Find datasets without owners")
         .when(et == "view", F.concat(F.lit("Show downstream impact of fct_"), uid))
         .when(et == "purchase", "Create a governance report for this week")
         .otherwise(F.concat(F.lit("Generate documentation for finance.stg_"), uid)).alias("question"),
    )

    eid = F.col("event_id")
    run_trace = events.select(
        F.col("user_id").alias("run_id"),
        eid.alias("seq"),
        F.when(et == "click", "datasets").when(et == "view", "owners")
         .when(et == "purchase", "lineage").when(et == "error", "statistics")
         .otherwise("planner").alias("node"),
        F.when(eid % 3 == 0, "ok").when(eid % 3 == 1, "skipped").otherwise("failed").alias("status"),
        F.col("value").alias("duration_ms"),
    )

    activity_events = events.select(
        "event_id", "ts",
        F.when(et == "purchase", "fix").when(et == "error", "finding")
         .when(et == "signup", "docs").otherwise("scan").alias("kind"),
        F.concat(F.lit("event "), eid.cast("string")).alias("title"),
    )

    return Catalog(assets=assets, domains=domains, principals=principals, ownership=ownership,
                   asset_tags=asset_tags, schema_fields=schema_fields,
                   schema_fields_prev=schema_fields_prev, lineage_edges=lineage_edges,
                   profiles=profiles, usage_events=usage_events, questions=questions,
                   run_trace=run_trace, activity_events=activity_events, glossary_terms=glossary_terms, links=links,
                   custom_properties=custom_properties, primary_keys=primary_keys, tags=tags, domain_owners=domain_owners)
