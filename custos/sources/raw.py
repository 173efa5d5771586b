"""Raw catalogue documents (S2) -> catalogue tables.

Documents are deeply nested, sparse JSON (one dataset per line). They are
read under one explicit schema in PERMISSIVE mode, so an absent aspect is a
null struct rather than an error and no schema inference pass is needed.
Scalars that upstream systems send inconsistently typed (numbers as text,
booleans, epoch millis) are read as text and coerced with the lenient column
helpers. Every nested list becomes a long child table via ``posexplode`` -
nothing is regrouped, so a document with a huge owner or field list is just
more rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custos.functions import columns as C
from custos.sources.catalog import Catalog

S = T.StringType()


def _st(*fields) -> T.StructType:
    return T.StructType([f if isinstance(f, T.StructField) else T.StructField(f[0], f[1]) for f in fields])


def _arr(t) -> T.ArrayType:
    return T.ArrayType(t)


OWNER_ENTITY = _st(("__typename", S), ("urn", S), ("username", S), ("name", S),
                   ("properties", _st(("displayName", S), ("email", S), ("title", S), ("active", S))),
                   ("editableProperties", _st(("displayName", S), ("email", S))))
TAG_ENTITY = _st(("urn", S), ("name", S), ("properties", _st(("name", S), ("description", S), ("colorHex", S))))
TERM_ENTITY = _st(("urn", S), ("name", S), ("properties", _st(("name", S), ("description", S))))
PLATFORM = _st(("urn", S), ("name", S), ("properties", _st(("displayName", S), ("type", S))))
DOMAIN = _st(("urn", S), ("id", S), ("properties", _st(("name", S), ("description", S))))

RAW_DATASET = _st(
    ("urn", S), ("type", S), ("name", S),
    ("platform", PLATFORM),
    ("subTypes", _st(("typeNames", _arr(S)))),
    ("properties", _st(("name", S), ("qualifiedName", S), ("description", S), ("externalUrl", S),
                       ("lastModified", _st(("time", S))), ("created", S),
                       ("customProperties", _arr(_st(("key", S), ("value", S)))))),
    ("editableProperties", _st(("description", S))),
    ("ownership", _st(("owners", _arr(_st(
        ("type", S), ("ownershipType", _st(("urn", S), ("info", _st(("name", S), ("description", S))))),
        ("owner", OWNER_ENTITY)))))),
    ("domain", _st(("domain", DOMAIN))),
    ("tags", _st(("tags", _arr(_st(("tag", TAG_ENTITY)))))),
    ("deprecation", _st(("deprecated", S), ("note", S), ("decommissionTime", S))),
    ("lastIngested", S),
    ("glossaryTerms", _st(("terms", _arr(_st(("term", TERM_ENTITY)))))),
    ("schemaMetadata", _st(("name", S), ("primaryKeys", _arr(S)), ("fields", _arr(_st(
        ("fieldPath", S), ("label", S), ("description", S), ("nullable", S), ("isPartOfKey", S),
        ("type", S), ("nativeDataType", S)))))),
    ("institutionalMemory", _st(("elements", _arr(_st(("url", S), ("description", S)))))),
)

RAW_PROFILE = _st(
    ("urn", S), ("timestampMillis", S), ("rowCount", S), ("columnCount", S), ("sizeInBytes", S),
    ("fieldProfiles", _arr(_st(("fieldPath", S), ("uniqueCount", S), ("uniqueProportion", S),
                               ("nullCount", S), ("nullProportion", S), ("min", S), ("max", S),
                               ("mean", S), ("median", S), ("stdev", S)))))


def as_bool(c) -> "F.Column":
    """Strict boolean: only true/false text counts; anything else is null."""
    t = F.lower(C.col_(c))
    return F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False))


def read_raw(spark: SparkSession, path: str, schema: T.StructType = RAW_DATASET,
             multi_line: bool = False) -> DataFrame:
    return (spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", multi_line)
            .json(path))


def parse_raw(docs: DataFrame, column: str = "doc", schema: T.StructType = RAW_DATASET) -> DataFrame:
    """Same as ``read_raw`` for documents held in a text column."""
    return docs.select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("d")).select("d.*")


def raw_counts(raw: DataFrame) -> DataFrame:
    """Source total vs kept rows (rows without a URN are dropped, the total is kept)."""
    return raw.agg(F.count(F.lit(1)).alias("source_total"),
                   F.count_if(C.clean_text("urn").isNotNull()).alias("kept"))


def catalog_from_raw(raw: DataFrame) -> Catalog:
    """Flatten raw documents into the catalogue tables (assets keyed by a hash id)."""
    urn = C.clean_text("urn")
    docs = raw.where(urn.isNotNull()).select("*", F.xxhash64(urn).alias("asset_id"))
    assets = docs.select(
        "asset_id", C.clean_text("urn").alias("urn"),
        F.coalesce(C.clean_text("platform.name"),
                   F.substring_index(C.clean_text("platform.urn"), ":", -1)).alias("platform"),
        F.coalesce(C.clean_text("properties.name"), C.clean_text("name")).alias("name"),
        C.clean_text("properties.description").alias("description"),
        C.clean_text("editableProperties.description").alias("editable_description"),
        F.when(F.col("deprecation").isNotNull(), F.coalesce(as_bool("deprecation.deprecated"), F.lit(False)))
         .alias("deprecated"),
        C.clean_text("domain.domain.urn").alias("domain_urn"),
        F.lit(None).cast("boolean").alias("schema_drift"),
        C.to_int("properties.lastModified.time").alias("last_modified_ms"),
        C.clean_text("properties.qualifiedName").alias("qualified_name"),
        C.clean_text("properties.externalUrl").alias("external_url"),
        C.ts_from_millis("lastIngested").alias("last_ingested"),
        C.ts_from_millis("properties.created").alias("created"),
        F.coalesce(F.filter("subTypes.typeNames", lambda t: t.isNotNull()), F.array().cast("array<string>")).alias("sub_types"))

    owners = docs.select("asset_id", F.posexplode("ownership.owners").alias("pos", "o"))
    ownership = owners.select(
        "asset_id", F.col("pos").cast("bigint").alias("pos"), C.clean_text("o.owner.urn").alias("owner_urn"),
        F.coalesce(C.clean_text("o.ownershipType.info.name"), C.clean_text("o.type")).alias("ownership_type"))
    name = F.coalesce(C.clean_text("o.owner.username"), C.clean_text("o.owner.name"))
    principals = owners.select(
        C.clean_text("o.owner.urn").alias("owner_urn"),
        F.when(F.col("o.owner.__typename") == "CorpUser", "USER")
         .when(F.col("o.owner.__typename") == "CorpGroup", "GROUP")
         .otherwise(C.owner_kind(C.clean_text("o.owner.urn"))).alias("kind"),
        name.alias("name"),
        F.coalesce(C.clean_text("o.owner.properties.displayName"), name).alias("display_name"),
        C.clean_text("o.owner.editableProperties.displayName").alias("editable_display_name"),
        C.clean_text("o.owner.editableProperties.email").alias("editable_email"),
        C.clean_text("o.owner.properties.email").alias("email"),
        C.clean_text("o.owner.properties.title").alias("title"),
        as_bool("o.owner.properties.active").alias("active"),
    ).where(F.col("owner_urn").isNotNull())
    # the same principal may appear in many documents: keep one deterministic row
    pcols = [c for c in principals.columns if c != "owner_urn"]
    # (the most complete description wins, then the smallest values)
    filled = sum((F.col(c).isNotNull().cast("int") for c in pcols), F.lit(0))
    principals = (principals.groupBy("owner_urn")
                  .agg(F.max(F.struct(filled.alias("_filled"), *[F.struct(F.col(c).isNotNull().alias("_n"), F.col(c).alias("v")).alias(c) for c in pcols])).alias("p"))
                  .select("owner_urn", *[F.col(f"p.{c}.v").alias(c) for c in pcols]))

    tags = docs.select("asset_id", F.explode("tags.tags").alias("t")).select(
        "asset_id", C.clean_text("t.tag.urn").alias("tag_urn"),
        F.coalesce(C.clean_text("t.tag.properties.name"), C.clean_text("t.tag.name")).alias("tag"),
        C.clean_text("t.tag.properties.description").alias("tag_description"),
        C.clean_text("t.tag.properties.colorHex").alias("color_hex"),
    ).where(F.col("tag_urn").isNotNull())

    fields = docs.select("asset_id", F.posexplode("schemaMetadata.fields").alias("pos", "f"))
    schema_fields = fields.select(
        "asset_id", (F.col("pos") + 1).alias("pos"), C.clean_text("f.fieldPath").alias("field_path"),
        C.clean_text("f.nativeDataType").alias("native_data_type"), C.clean_text("f.type").alias("type"),
        C.clean_text("f.label").alias("label"), C.clean_text("f.description").alias("field_description"),
        as_bool("f.nullable").alias("nullable"),
        F.coalesce(as_bool("f.isPartOfKey"), F.lit(False)).alias("is_part_of_key"),
    ).where(F.col("field_path").isNotNull())

    domains = docs.select(C.clean_text("domain.domain.urn").alias("domain_urn"),
                          C.clean_text("domain.domain.properties.name").alias("name")).where(
        F.col("domain_urn").isNotNull()).groupBy("domain_urn").agg(F.min("name").alias("name"))

    return Catalog(assets=assets, domains=domains, principals=principals, ownership=ownership,
                   asset_tags=tags, schema_fields=schema_fields)


def glossary_terms(raw: DataFrame) -> DataFrame:
    """Glossary terms per asset; name falls back to the URN tail."""
    urn = C.clean_text("urn")
    t = raw.where(urn.isNotNull()).select(urn.alias("urn"), F.explode("glossaryTerms.terms").alias("t"))
    term_urn = C.clean_text("t.term.urn")
    return t.select("urn", term_urn.alias("term_urn"),
                    F.coalesce(C.clean_text("t.term.properties.name"), C.clean_text("t.term.name"),
                               F.substring_index(term_urn, ":", -1)).alias("term"),
                    C.clean_text("t.term.properties.description").alias("description")).where(
        F.col("term_urn").isNotNull())


def documentation_links(raw: DataFrame) -> DataFrame:
    """Institutional-memory links; entries without a URL are dropped."""
    urn = C.clean_text("urn")
    e = raw.where(urn.isNotNull()).select(urn.alias("urn"), F.posexplode("institutionalMemory.elements").alias("pos", "e"))
    return e.select("urn", "pos", C.clean_text("e.url").alias("url"),
                    C.clean_text("e.description").alias("description")).where(F.col("url").isNotNull())


def custom_properties(raw: DataFrame) -> DataFrame:
    """key/value list -> map; blank keys dropped, the last duplicate wins."""
    raw.sparkSession.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    urn = C.clean_text("urn")
    kv = F.filter(F.transform(F.coalesce("properties.customProperties",
                                         F.array().cast("array<struct<key:string,value:string>>")),
                              lambda p: F.struct(C.clean_text(p["key"]).alias("key"),
                                                 F.coalesce(p["value"], F.lit("")).alias("value"))),
                  lambda p: p["key"].isNotNull())
    return raw.where(urn.isNotNull()).select(urn.alias("urn"), F.map_from_entries(kv).alias("custom_properties"))


def render_documents(cat: Catalog) -> DataFrame:
    """One nested catalogue document (JSON text) per asset, rendered from the
    catalogue's scalar aspects (properties, editable properties, platform,
    domain, deprecation). Absent values are omitted, as a sparse source would."""
    a = cat.assets
    props = F.struct(F.col("name").alias("name"), F.col("description").alias("description"),
                     F.struct(F.col("last_modified_ms").alias("time")).alias("lastModified"))
    doc = F.struct(
        F.col("urn").alias("urn"), F.lit("DATASET").alias("type"),
        F.struct(F.col("platform").alias("name"),
                 F.concat(F.lit("urn:li:dataPlatform:"), F.col("platform")).alias("urn")).alias("platform"),
        props.alias("properties"),
        F.when(F.col("editable_description").isNotNull(),
               F.struct(F.col("editable_description").alias("description"))).alias("editableProperties"),
        F.when(F.col("domain_urn").isNotNull(),
               F.struct(F.struct(F.col("domain_urn").alias("urn")).alias("domain"))).alias("domain"),
        F.when(F.col("deprecated").isNotNull(),
               F.struct(F.col("deprecated").alias("deprecated"))).alias("deprecation"))
    return a.select(F.to_json(doc).alias("doc"))
