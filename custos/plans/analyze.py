"""Question -> governance answer, as lazily composed DataFrames.

``analyze(catalog, question)`` classifies the question with the same Column
expressions the batch classifier uses (on a one-row frame; only that single
classification row reaches the driver), then builds only the frames its plan
needs. Nothing heavy runs until the caller acts on a frame, except the lineage
hop loop when the plan includes lineage.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custos.operators import assets as A
from custos.operators import lineage as G
from custos.operators import questions as Q
from custos.operators import reports as T
from custos.operators import rollups as U
from custos.operators import rules as R
from custos.operators import usage as S
from custos.functions.joins import small_side
from custos.sources.catalog import Catalog


@dataclass
class Answer:
    question: str
    intent: str
    confident: bool
    reason: str
    plan: list[str]
    target_urn: str | None
    target_name: str | None
    frames: dict[str, DataFrame] = field(default_factory=dict)


CHILDREN = ("ownership", "asset_tags", "schema_fields", "schema_fields_prev", "profiles", "usage_events")


def narrowed(cat: Catalog, assets: DataFrame) -> Catalog:
    """The catalogue of some assets: every child table cut to them before anything is aggregated."""
    ids = small_side(assets.select("asset_id").distinct())
    tables = {n: getattr(cat, n).join(ids, "asset_id", "left_semi") for n in CHILDREN if getattr(cat, n) is not None}
    return cat.with_tables(assets=assets, **tables)


def analyze(cat: Catalog, question: str, threshold: int = 5, max_hops: int | None = None) -> Answer:
    spark = cat.spark
    q = spark.createDataFrame([(0, question)], "question_id long, question string")
    row = Q.classify_questions(q).first()
    plan = row.plan.split(",")
    frames: dict[str, DataFrame] = {}

    named = None
    if row.target_urn:
        # one precise lookup: the plain comparison reaches the scan
        named = cat.assets.where(F.col("urn") == row.target_urn)
    elif row.target_name:
        # a probable name: search for it, but a guess that matches nothing must not give an
        # empty, confidently wrong answer - then the whole catalogue is scanned
        t = row.target_name.lower()
        found = cat.assets.where((F.lower(F.trim("name")) == t) | F.lower("urn").contains(t))
        named = None if found.isEmpty() else found
    scoped = cat if named is None else narrowed(cat, named)
    assets = A.clean_assets(scoped)
    frames["datasets"] = assets

    downstream = None
    if "lineage" in plan:
        roots = assets.select(F.col("asset_id").alias("root"))
        if named is None:
            downstream = G.downstream_counts(cat, max_hops)
            roots = G.lineage_root(scoped).select("root")
        else:  # only what the named assets reach
            downstream = G.reachability(cat, roots, "DOWNSTREAM", max_hops).groupBy(
                F.col("root").alias("asset_id")).agg(F.count(F.lit(1)).alias("downstream_count"))
        frames["lineage"] = G.lineage_impact(cat, None, roots)
    if "owners" in plan:
        frames["owners"] = A.asset_owners(scoped)
    if "statistics" in plan:
        frames["statistics"] = S.statistics_summary(scoped)
    if "risk" in plan:
        frames["findings"] = R.findings(scoped, downstream, threshold)
        frames["verdict"] = R.catalogue_verdict(scoped, downstream, threshold)
        frames["evidence"] = R.evidence(scoped, downstream, threshold)
    if "reasoning" in plan and "findings" in frames:
        frames["summary"] = T.scan_summary(R.scored_facts(scoped, downstream, threshold),
                                           frames["findings"]).where(F.col("domain") == "*")
    if "recommendation" in plan and "findings" in frames:
        frames["recommendations"] = U.recommendations(frames["findings"])
    if "report" in plan and "findings" in frames:
        recs = frames.get("recommendations", U.recommendations(frames["findings"]))
        frames["report"] = T.executive_report(frames["verdict"], frames["findings"], recs, question, row.intent)
    if row.intent == "generate_documentation":
        frames["dictionary"] = T.data_dictionary(scoped)
    return Answer(question, row.intent, row.confident, row.reason, plan, row.target_urn,
                  row.target_name, frames)
