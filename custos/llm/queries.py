"""The registered ``opN_*`` queries: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custos.llm import (
    decontaminate,
    infill,
    language,
    mixing,
    near,
    neighbours,
    pages,
    quality,
    repeats,
    resample,
    tokens,
    toolcalls,
    urls,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.drop_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return out.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs.select("doc_id", "text"), language.learn(docs)).drop("runs")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", F.col("n_shingles").cast("bigint").alias("n_shingles"),
        F.col("n_found").cast("bigint").alias("n_found"))


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toolcalls.linked(*toolcalls.calls_of(_table(spark, sf_dir, "conversations")))
    return out.select("kind", "conversation", "call_id", "seq", "tool", "level", "n_results", "valid",
                      F.array_join("problems", "; ").alias("problems"), "message")


def mixing_tree() -> tuple[dict, dict]:
    """Levels and integer weights of the documents' tree: a domain is four sources by number."""
    number = F.coalesce(F.regexp_extract(F.col("source"), "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    levels = {"domain": F.concat(F.lit("domain"), (number % 4).cast("string")),
              "language": F.col("lang"), "origin": F.col("source")}
    origin = F.coalesce(F.regexp_extract(F.col("origin"), "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    weights = {"domain": F.substring("domain", 7, 1).try_cast("int") + 1,
               "language": F.when(F.col("language") == "en", 4).when(F.col("language").isin("de", "fr"), 2).otherwise(1),
               "origin": origin % 3 + 1}
    return levels, weights


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, weights = mixing_tree()
    out = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"),
                     levels, weights, percent=70, max_epochs=3, seed="mix")
    return out.select("doc_id", "lang", "source", "n_tokens", "copies", "leaf_budget")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near.near_groups(_table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return groups.select("doc_id", "n_shingles", "component_id",
                         F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, least_words=20,
                            ngrams=1, buckets=10_000, seed="2024", keep=["doc_id"])
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = infill.Plan(unit="line", percent=100, spm_percent=50, seed="7")
    return infill.digests(_table(spark, sf_dir, "documents"), plan)


URL_RULES = [urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
             urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/")]
# No list of URLs is given; these labels of a host make a page's address stand on it.
LISTED_LABELS = r"(^|\.)(spam|casino)[^.]*\."


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages_ = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages_.where(urls.host_of("url").rlike(LISTED_LABELS)).select("url")
    return urls.judge(pages_, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language": op3_language,
    "op4_neighbours": op4_neighbours,
    "op5_main_text": op5_main_text,
    "op6_decontaminate": op6_decontaminate,
    "op7_tool_calls": op7_tool_calls,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_resample": op11_resample,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_url_filter": op13_url_filter,
}
