"""Ranked catalogue search (F3) over an inverted index.

The index is three written tables, partitioned by a hash bucket of their key and sorted by it inside:

* ``grams``: (gram, doc, at) - each three-character run of an entity's searched text, with its place;
* ``tokens``: (token, doc, tf, length) - each word, its weight in the entity (name over description over URN) and
  the entity's number of words;
* ``gram_counts`` and ``token_counts``: in how many entities each occurs (and one row for the whole corpus).

The searched text of an entity is its lower-cased name, URN and description, joined by a space (as in ``assets.asset_search``),
and an entity matches if that text contains the whole query. The query is covered by its runs at every third place;
their posting lists are joined from the rarest on by entity and start, so what is left holds the whole query at that start:
the match is verified by places alone, and no text is read. Matches are ranked by BM25 over the query's words. A search reads
the buckets of its own runs and words only; queries of one or two characters, which have no run, scan the entity table.

All kinds of entities are indexed (datasets, domains, tags, users and groups); ``entity_types`` chooses among them.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custos.functions import columns as C
from custos.functions.ranking import global_rank
from custos.operators.assets import clean_assets, domains_clean, principals_clean, tags_clean
from custos.session import ensure_checkpoint_dir
from custos.sources.catalog import Catalog

GRAM = 3
# How much a word counts in each field.
WEIGHTS = {"name": 4, "description": 2, "urn": 1}
K1, B = 1.2, 0.75
SCHEMAS = {
    "entities": "entity_type string, entity_urn string, asset_id bigint, name string, platform string, urn string, description string, doc bigint",
    "grams": "gram string, doc bigint, entity_type string, platform string, at int, bucket int",
    "gram_counts": "gram string, n_docs bigint, n_places bigint, bucket int",
    "tokens": "token string, doc bigint, tf bigint, length bigint, bucket int",
    "token_counts": "token string, n_docs bigint, bucket int",
    "corpus": "n_docs bigint, n_words bigint",
}
_ROWS_A_FILE = 1 << 20


def entities(cat: Catalog) -> DataFrame:
    """(entity_type, entity_urn, asset_id, name, platform, urn, description): everything that can be found."""
    none = F.lit(None).cast("string")
    data = clean_assets(cat).select(F.lit("DATASET").alias("entity_type"), F.col("urn").alias("entity_urn"), "asset_id",
                                    F.col("display_name").alias("name"), "platform", "urn", "description")
    rest = [
        domains_clean(cat).select(F.lit("DOMAIN").alias("entity_type"), F.col("domain_urn").alias("entity_urn"), F.col("domain_name").alias("name")),
        tags_clean(cat).select(F.lit("TAG").alias("entity_type"), F.col("tag_urn").alias("entity_urn"), F.col("tag").alias("name")).distinct(),
        principals_clean(cat).select(F.when(C.owner_kind("owner_urn") == "GROUP", "CORP_GROUP").otherwise("CORP_USER").alias("entity_type"),
                                     F.col("owner_urn").alias("entity_urn"), F.col("display_name").alias("name")),
    ]
    return reduce(DataFrame.unionByName, [data, *[r.select("*", F.lit(None).cast("bigint").alias("asset_id"), none.alias("platform"),
                                                           F.col("entity_urn").alias("urn"), none.alias("description")) for r in rest]])


def _bucket(text: str, buckets: int) -> int:
    return zlib.crc32(text.encode()) % buckets


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(buckets)).cast("int")


def words(text: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def query_words(query: str) -> list[str]:
    return sorted(set("".join(c if c.isalnum() else " " for c in query.lower()).split()))


def pieces(query: str) -> list[tuple[str, int]]:
    """(run, place) that cover a query of ``GRAM`` characters or more: every third place and the last."""
    last = len(query) - GRAM
    return [(query[i:i + GRAM], i) for i in sorted({*range(0, last, GRAM), last})]


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    root: str
    buckets: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def postings(self, name: str, key: str, values: list[str]) -> DataFrame:
        """The rows of these keys: other buckets' folders aren't opened."""
        at = sorted({_bucket(v, self.buckets) for v in values})
        return self.table(name).where(F.col("bucket").isin(*at) & F.col(key).isin(*values))


def build_index(cat: Catalog, root: str | None = None, buckets: int | None = None) -> SearchIndex:
    """Write the index under ``root`` (default: a new folder of the shared checkpoint directory) in ``buckets`` buckets
    (default: the session's shuffle partitions)."""
    spark = cat.spark
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/custos-search-{uuid.uuid4().hex[:12]}"

    def keyed(df: DataFrame, name: str, key: str) -> None:
        # ranges of (bucket, key, entity): a key that all entities have is spread over tasks and files
        df = df.withColumn("bucket", bucket_of(key, buckets))
        order = ["bucket", key, *(["doc"] if "doc" in df.columns else [])]
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", _ROWS_A_FILE).partitionBy("bucket").parquet(f"{root}/{name}")

    text = F.lower(F.concat_ws(" ", "name", "urn", "description"))
    entities(cat).withColumn("doc", F.monotonically_increasing_id()).write.parquet(f"{root}/entities")
    index = SearchIndex(spark, root, buckets)
    e = index.table("entities")
    runs = e.select("doc", "entity_type", "platform", text.alias("text")).where(F.length("text") >= GRAM)
    runs = runs.select("doc", "entity_type", "platform", "text", F.explode(F.sequence(F.lit(0), F.length("text") - GRAM)).alias("at"))
    keyed(runs.select(F.substring("text", F.col("at") + 1, F.lit(GRAM)).alias("gram"), "doc", "entity_type", "platform", "at"), "grams", "gram")
    grams = index.table("grams")
    keyed(grams.groupBy("gram").agg(F.count_distinct("doc").alias("n_docs"), F.count(F.lit(1)).alias("n_places")), "gram_counts", "gram")
    fields = [e.select("doc", F.lit(w).alias("weight"), words(F.col(f)).alias("w")) for f, w in WEIGHTS.items()]
    said = reduce(DataFrame.unionByName, fields).where("w is not null").select("doc", "weight", F.explode("w").alias("token"))
    length = said.groupBy("doc").agg(F.count(F.lit(1)).alias("length"))
    keyed(said.groupBy("token", "doc").agg(F.sum("weight").alias("tf")).join(length, "doc").select("token", "doc", "tf", "length"), "tokens", "token")
    keyed(index.table("tokens").groupBy("token").agg(F.count(F.lit(1)).alias("n_docs")), "token_counts", "token")
    # entities without a word count too
    n_docs = e.select(F.count(F.lit(1))).scalar()
    length.agg(n_docs.alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_words")).write.parquet(f"{root}/corpus")
    return index


def _wanted(df: DataFrame, entity_types: list[str] | None, platforms: list[str] | None) -> DataFrame:
    if entity_types:
        df = df.where(F.col("entity_type").isin(*entity_types))
    return df.where(F.col("platform").isin(*platforms)) if platforms else df


def matching(index: SearchIndex, query: str, entity_types: list[str] | None = None, platforms: list[str] | None = None) -> DataFrame:
    """(doc): entities whose searched text contains the query."""
    q = query.strip().lower()
    if len(q) < GRAM:
        e = _wanted(index.table("entities"), entity_types, platforms)
        return e.where(F.instr(F.lower(F.concat_ws(" ", "name", "urn", "description")), q) > 0).select("doc") if q and q != "*" else e.select("doc")
    parts = pieces(q)
    runs = sorted({g for g, _ in parts})
    often = {r["gram"]: r["n_places"] for r in index.postings("gram_counts", "gram", runs).collect()}  # a row a run of the query
    found = None
    for gram, place in sorted(parts, key=lambda p: (often.get(p[0], 0), p[1])):
        at = _wanted(index.postings("grams", "gram", [gram]), entity_types, platforms).select("doc", (F.col("at") - place).alias("start"))
        found = at if found is None else found.join(at, ["doc", "start"])
    return found.select("doc").distinct()


def search(index: SearchIndex, query: str, entity_types: list[str] | None = None, platforms: list[str] | None = None) -> DataFrame:
    """(doc, score) of the matching entities; the score is BM25 over the query's words (0 if it has none, or they occur only
    inside other words)."""
    hits = matching(index, query, entity_types, platforms)
    said = query_words(query)
    if not said:
        return hits.withColumn("score", F.lit(0.0))
    n, total = index.table("corpus").first()
    often = {r["token"]: r["n_docs"] for r in index.postings("token_counts", "token", said).collect()}  # a row a word of the query
    idf = F.coalesce(*[F.when(F.col("token") == w, F.log(F.lit(1 + (n - d + 0.5) / (d + 0.5)))) for w, d in often.items()], F.lit(0.0))
    mean = total / n if n and total else 1.0
    tf = F.col("tf").cast("double")
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / mean))
    scored = index.postings("tokens", "token", said).groupBy("doc").agg(F.sum(part).alias("score"))
    return hits.join(scored, "doc", "left").select("doc", F.coalesce("score", F.lit(0.0)).alias("score"))


def ranked(index: SearchIndex, query: str, entity_types: list[str] | None = None, platforms: list[str] | None = None,
           count: int | None = None) -> DataFrame:
    """(position, entity_type, entity_urn, asset_id, name, platform, score), best first, ties by URN; the first ``count`` if given.
    ``entity_types`` is ["DATASET"] unless named."""
    hits = search(index, query, entity_types or ["DATASET"], platforms)
    shown = index.table("entities").join(hits, "doc").select(
        "entity_type", "entity_urn", "asset_id", "name", "platform", F.round("score", 6).alias("score"))
    order = [F.desc("score"), F.col("entity_urn").asc(), F.col("entity_type").asc()]
    return global_rank(shown if count is None else shown.orderBy(*order).limit(count), order, "position")


_INDEXES: dict = {}


def index_of(cat: Catalog) -> SearchIndex:
    """The catalogue's index, built once a session."""
    hit = _INDEXES.get(id(cat.assets))
    if hit is None:
        hit = _INDEXES[id(cat.assets)] = (cat.assets, build_index(cat))
    return hit[1]
