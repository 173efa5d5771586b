"""A training corpus from ``documents`` in five stages, each of which applies one operator to all
documents that its predecessor kept; every stage is written as Parquet and read again.

1. quality: documents below the quality threshold go (Bradley-Terry scores).
2. near_duplicates: of each group of near duplicates (five-word shingles, similarity 0.8 or more)
   the document with the smallest doc_id stays.
3. substring_dedup: passages of 35 words or more that also start elsewhere are cut out of the texts;
   documents stay, texts without repeats stay as they are.
4. decontamination: documents that hold a benchmark item (80 % of its five-word shingles) go.
5. mixing: every document that the target weights take at least once, with its copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custos.llm import decontaminate, mixing, near, quality, repeats
from custos.llm.queries import mixing_tree
from custos.llm.scratch import Scratch, column, fresh

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_first(docs, shingle=5, percent=80)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    removed, = fresh(docs, "n_removed")
    cut = repeats.drop_repeats(docs, tidy=False)
    length = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length.cast("bigint")).select(*[column(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    levels, weights = mixing_tree()
    return mixing.mix(docs, levels, weights, percent=100, max_epochs=4, seed="corpus")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

# SQL cannot express the learned scores nor connected components of near duplicates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = Scratch(spark)
    for _, stage in STAGES:
        docs = s.table(stage(spark, docs, sf_dir), keep=True)
    return docs
