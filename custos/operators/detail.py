"""What a catalogue's detail view adds to its lists: terms, links, properties, schema and keys of an asset, its deprecation,
the attributes of principals, tags and domains.

Everything of which an asset can have many is a long table keyed by asset, in order; the detail row (``asset_detail``) holds
scalars and counts, so no row grows with a hot asset. Missing tables and columns read as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custos.functions import columns as C
from custos.functions.joins import small_side, to_many
from custos.operators.assets import clean_assets, owners_dedup, principals_clean, schema_clean, tags_clean
from custos.sources.catalog import Catalog


def _column(df: DataFrame, name: str, kind: str = "string") -> F.Column:
    if name not in df.columns:
        return F.lit(None).cast(kind)
    return C.clean_text(name) if kind == "string" else F.col(name)


def _children(cat: Catalog, name: str, ddl: str) -> DataFrame:
    """A table keyed by asset, or an empty one."""
    table = getattr(cat, name)
    return table if table is not None else cat.spark.createDataFrame([], ddl)


# --- P2: principals ------------------------------------------------------------------------

def principal_details(cat: Catalog) -> DataFrame:
    """Principals with email (the edited one first) and title."""
    p = cat.principals
    more = p.select(C.clean_text("owner_urn").alias("owner_urn"), F.coalesce(_column(p, "editable_email"), _column(p, "email")).alias("email"),
                    _column(p, "title").alias("title"))
    return principals_clean(cat).join(more, "owner_urn").select("owner_urn", "kind", "name", "display_name", "email", "title", "active")


# --- P3 / P7: terms, links, properties -------------------------------------------------------

def terms(cat: Catalog) -> DataFrame:
    """(asset_id, pos, term_urn, term, description); entries without URN go, a term without name has its URN's tail."""
    t = _children(cat, "glossary_terms", "asset_id bigint, pos int, term_urn string, name string, description string")
    urn = C.clean_text("term_urn")
    return t.select("asset_id", "pos", urn.alias("term_urn"), F.coalesce(C.clean_text("name"), F.substring_index(urn, ":", -1)).alias("term"),
                    C.clean_text("description").alias("description")).where("term_urn is not null")


def links(cat: Catalog) -> DataFrame:
    """(asset_id, pos, url, description); entries without URL go."""
    e = _children(cat, "links", "asset_id bigint, pos int, url string, description string")
    return e.select("asset_id", "pos", C.clean_text("url").alias("url"), C.clean_text("description").alias("description")).where("url is not null")


def properties(cat: Catalog) -> DataFrame:
    """(asset_id, key, value); blank keys go, the last of equal keys counts, a missing value is empty. The last one is a
    maximum by position, which combines before the shuffle."""
    p = _children(cat, "custom_properties", "asset_id bigint, pos int, key string, value string")
    p = p.select("asset_id", "pos", C.clean_text("key").alias("key"), F.coalesce("value", F.lit("")).alias("value")).where("key is not null")
    return p.groupBy("asset_id", "key").agg(F.max(F.struct("pos", "value")).alias("last")).select("asset_id", "key", F.col("last.value").alias("value"))


def _of_assets(cat: Catalog, rows: DataFrame, requested: DataFrame | None) -> DataFrame:
    a = clean_assets(cat).select("asset_id", "urn")
    if requested is not None:
        a = a.join(requested.select("urn").distinct(), "urn", "left_semi")
    return to_many(a, rows, "asset_id", "inner")


def asset_terms(cat: Catalog, requested: DataFrame | None = None) -> DataFrame:
    return _of_assets(cat, terms(cat), requested).select("asset_id", "urn", "pos", "term_urn", "term", "description")


def asset_links(cat: Catalog, requested: DataFrame | None = None) -> DataFrame:
    return _of_assets(cat, links(cat), requested).select("asset_id", "urn", "pos", "url", "description")


def asset_properties(cat: Catalog, requested: DataFrame | None = None) -> DataFrame:
    return _of_assets(cat, properties(cat), requested).select("asset_id", "urn", "key", "value")


# --- P4 / P5 / S4: deprecation, schema, keys ---------------------------------------------------

def deprecations(cat: Catalog) -> DataFrame:
    """The deprecation aspect of the assets that have one, deprecated or not."""
    a = cat.assets
    return a.where(F.col("deprecated").isNotNull()).select(
        "asset_id", C.clean_text("urn").alias("urn"), "deprecated", _column(a, "deprecation_note").alias("note"),
        C.iso(C.ts_from_millis(_column(a, "decommission_ms", "bigint"))).alias("decommission_time")).where("urn is not null")


def fields(cat: Catalog) -> DataFrame:
    """P5: schema fields with label, type, nullability (unknown stays null) and whether they are part of the key."""
    s = cat.schema_fields
    return s.select("asset_id", "pos", C.clean_text("field_path").alias("field_path"), _column(s, "label").alias("label"), _column(s, "type").alias("type"),
                    C.clean_text("native_data_type").alias("native_data_type"), _column(s, "nullable", "boolean").alias("nullable"),
                    F.coalesce(_column(s, "is_part_of_key", "boolean"), F.lit(False)).alias("is_part_of_key"),
                    _column(s, "field_description").alias("description")).where("field_path is not null")


def primary_keys(cat: Catalog) -> DataFrame:
    k = _children(cat, "primary_keys", "asset_id bigint, pos int, field_path string")
    return k.where("field_path is not null").select("asset_id", "pos", "field_path")


def schema_detail(cat: Catalog, requested: DataFrame | None = None) -> DataFrame:
    """Every field of each asset with its place among the primary keys (null: none). Assets without a schema have no row here;
    ``asset_detail`` counts them with 0 fields."""
    key = primary_keys(cat).select("asset_id", "field_path", F.col("pos").alias("key_pos")).groupBy("asset_id", "field_path").agg(F.min("key_pos").alias("key_pos"))
    return _of_assets(cat, fields(cat).join(key, ["asset_id", "field_path"], "left"), requested).select(
        "asset_id", "urn", "pos", "field_path", "label", "type", "native_data_type", "nullable", "is_part_of_key", "key_pos", "description")


# --- P6 / S3: the detail row ---------------------------------------------------------------------

def asset_detail(cat: Catalog, requested: DataFrame | None = None) -> DataFrame:
    """One row an asset with its time of creation, deprecation, and how many of each child it has. With ``requested`` (urn) the
    rows asked for, those not found with found = false."""
    counts = {"n_owners": owners_dedup(cat), "n_tags": tags_clean(cat), "n_terms": terms(cat), "n_fields": schema_clean(cat),
              "n_keys": primary_keys(cat), "n_links": links(cat), "n_properties": properties(cat)}
    # one aggregate over all child tables: a hot asset sends one partial row a task
    every = reduce(DataFrame.unionByName, [t.select("asset_id", F.lit(name).alias("what")) for name, t in counts.items()])
    every = every.groupBy("asset_id").agg(*[F.count_if(F.col("what") == name).alias(name) for name in counts])
    a = clean_assets(cat)
    created = cat.assets.select("asset_id", C.iso(C.ts_from_millis(_column(cat.assets, "created_ms", "bigint"))).alias("created"),
                                _column(cat.assets, "deprecation_note").alias("deprecation_note"))
    rows = a.select("asset_id", "urn", "name", "platform", "description", "deprecated", "domain_urn", "qualified_name", "external_url", "sub_types",
                    C.iso("last_modified").alias("last_modified"), C.iso("last_ingested").alias("last_ingested"))
    rows = rows.join(created, "asset_id").join(every, "asset_id", "left").select(
        *rows.columns, "created", F.when(F.col("deprecated"), F.col("deprecation_note")).alias("deprecation_note"),
        *[F.coalesce(name, F.lit(0)).alias(name) for name in counts])
    if requested is None:
        return rows.withColumn("found", F.lit(True))
    asked = requested.select(F.col("urn").alias("requested_urn")).distinct()
    return asked.join(rows, F.col("requested_urn") == F.col("urn"), "left").withColumn("found", F.col("urn").isNotNull())


# --- S5 / A4 / A5: vocabularies --------------------------------------------------------------------

def tag_vocabulary(cat: Catalog, query: str = "*") -> DataFrame:
    """Every tag of the vocabulary, used or not, and every tag in use, with description, colour and number of assets."""
    used = tags_clean(cat).groupBy("tag_urn").agg(F.count_distinct("asset_id").alias("asset_count"), F.min("tag").alias("used_name"))
    t = _children(cat, "tags", "tag_urn string, name string, description string, color_hex string")
    t = t.select(*[C.clean_text(c).alias(c) for c in ("tag_urn", "name", "description", "color_hex")]).where("tag_urn is not null")
    both = t.join(used, "tag_urn", "full_outer").select(
        "tag_urn", F.coalesce("name", "used_name", F.substring_index("tag_urn", ":", -1)).alias("name"), "description", "color_hex",
        F.coalesce("asset_count", F.lit(0)).alias("asset_count"))
    q = (query or "").strip().lower()
    return both if q in ("", "*") else both.where(F.instr(F.lower("name"), q) > 0)


def domain_owner_list(cat: Catalog) -> DataFrame:
    """A5: a domain's owners in order, each once with its first ownership type."""
    o = _children(cat, "domain_owners", "domain_urn string, pos bigint, owner_urn string, ownership_type string")
    o = o.select(C.clean_text("domain_urn").alias("domain_urn"), "pos", C.clean_text("owner_urn").alias("owner_urn"), C.clean_text("ownership_type").alias("ownership_type"))
    first = o.where("domain_urn is not null and owner_urn is not null").groupBy("domain_urn", "owner_urn").agg(F.min(F.struct("pos", "ownership_type")).alias("first"))
    named = principals_clean(cat).select("owner_urn", "name", "display_name")
    return first.join(small_side(named), "owner_urn", "left").select(
        "domain_urn", F.col("first.pos").alias("pos"), "owner_urn", C.owner_kind("owner_urn").alias("kind"),
        F.coalesce("display_name", "name", F.substring_index("owner_urn", ":", -1)).alias("display_name"), F.col("first.ownership_type").alias("ownership_type"))


def domain_detail(cat: Catalog, urn: str | None = None) -> DataFrame:
    """A5: a domain's id, name, description, number of assets and of owners; one domain by URN, or all."""
    d = cat.domains
    rows = d.select(C.clean_text("domain_urn").alias("domain_urn"), _column(d, "id").alias("id"), C.clean_text("name").alias("name"),
                    _column(d, "description").alias("description")).where("domain_urn is not null")
    if urn is not None:
        rows = rows.where(F.col("domain_urn") == urn)
    assets = clean_assets(cat).where("domain_urn is not null").groupBy("domain_urn").agg(F.count(F.lit(1)).alias("entity_count"))
    owners = domain_owner_list(cat).groupBy("domain_urn").agg(F.count(F.lit(1)).alias("owner_count"))
    return rows.join(assets, "domain_urn", "left").join(owners, "domain_urn", "left").select(
        *rows.columns, F.coalesce("entity_count", F.lit(0)).alias("entity_count"), F.coalesce("owner_count", F.lit(0)).alias("owner_count"))


def dataset_owners(cat: Catalog, requested: DataFrame) -> DataFrame:
    """A4: the owners of the requested datasets (urn), in order, each once; a dataset without owners, or not found, has no row."""
    named = principal_details(cat).select("owner_urn", "name", "display_name", "email", "title")
    return _of_assets(cat, owners_dedup(cat), requested).join(small_side(named), "owner_urn", "left").select(
        "asset_id", "urn", "pos", "owner_urn", C.owner_kind("owner_urn").alias("kind"), "ownership_type", "name", "display_name", "email", "title")
