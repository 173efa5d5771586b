"""Governance rules as Column expressions over the per-asset fact row.

All six conditions are evaluated in one ``select`` over the fact table and the
triggered ones are exploded into finding rows; the per-asset score is the sum
of the same conditions' points on the same row, so scoring never regroups the
findings. A custom rule is one more :class:`Rule` (a condition and a detail
Column over the fact row) appended to the list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custos.functions import columns as C
from custos.functions import fixed
from custos.functions.tables import Workspace
from custos.operators.assets import asset_facts, clean_assets, owners_dedup, schema_clean, tag_stats
from custos.sources.catalog import Catalog


@dataclass(frozen=True)
class Rule:
    key: str
    title: str
    points: int
    severity: str
    condition: Column
    detail: Column


def pii_columns(cat: Catalog) -> DataFrame:
    """schema columns whose name looks like personal data."""
    return schema_clean(cat).where(C.looks_like_pii("field_path")).select(
        "asset_id", "pos", "field_path")


def pii_stats(cat: Catalog) -> DataFrame:
    """Per asset: number of PII-looking columns and the first five (schema order).

    The first five come from a row_number <= 5 filter, which Spark plans as a
    map-side WindowGroupLimit, so even an asset with millions of columns ships
    at most five rows per map task."""
    pii = pii_columns(cat)
    counts = pii.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_pii"))
    w = Window.partitionBy("asset_id").orderBy("pos", "field_path")
    shown = (pii.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= fixed.PII_SHOWN)
             .groupBy("asset_id")
             .agg(F.array_sort(F.collect_list(F.struct("rn", "field_path"))).alias("s"))
             .select("asset_id", F.transform("s", lambda x: x["field_path"]).alias("pii_shown")))
    return counts.join(shown, "asset_id", "inner")


def pii_tagged_assets(cat: Catalog) -> DataFrame:
    """assets carrying a sensitivity tag."""
    t = tag_stats(cat).where("has_pii_tag").select("asset_id")
    return clean_assets(cat).join(t, "asset_id", "left_semi").select("asset_id", "urn")


def default_rules(threshold: int = fixed.DOWNSTREAM_THRESHOLD) -> list[Rule]:
    """R1-R6 over the fact row produced by ``asset_facts``."""
    title = {k: (t, p, s) for k, t, p, s in fixed.RULES}
    n = F.col("downstream")
    more = F.when(F.col("pii_count") > fixed.PII_SHOWN,
                  C.template(fixed.DETAIL_PII_MORE, n=F.col("pii_count") - fixed.PII_SHOWN)).otherwise(F.lit(""))
    conds = {
        "missing_owner": (F.col("owner_count") == 0, F.lit(fixed.DETAIL_MISSING_OWNER)),
        "missing_documentation": (F.col("description").isNull(),
                                  F.lit(fixed.DETAIL_MISSING_DOCUMENTATION)),
        "untagged_pii": ((F.col("pii_count") > 0) & ~F.col("pii_tagged"),
                         C.template(fixed.DETAIL_UNTAGGED_PII, shown=F.array_join("pii_shown", ", "), more=more)),
        "large_downstream_impact": (n >= F.lit(threshold), C.template(fixed.DETAIL_LARGE_DOWNSTREAM, n=n)),
        "deprecated_in_use": (F.col("deprecated") & (n > 0), C.template(fixed.DETAIL_DEPRECATED_IN_USE, n=n)),
        "schema_drift": (F.coalesce(F.col("schema_drift"), F.col("stats_schema_drift"), F.lit(False)),
                         F.lit(fixed.DETAIL_SCHEMA_DRIFT)),
    }
    return [Rule(k, title[k][0], title[k][1], title[k][2], conds[k][0], conds[k][1])
            for k, *_ in fixed.RULES]


def scored_facts(cat: Catalog, downstream: DataFrame | None = None,
                 threshold: int = fixed.DOWNSTREAM_THRESHOLD,
                 rules: list[Rule] | None = None,
                 stats_drift: DataFrame | None = None,
                 shared_downstream: int | None = None) -> DataFrame:
    """The fact row plus one boolean per rule, raw total, capped score and band.
    ``stats_drift`` (asset_id, schema_drift) is the statistics-borne drift
    signal; ``shared_downstream`` applies one total to every asset (parity)."""
    rules = rules or default_rules(threshold)
    f = asset_facts(cat, downstream, shared_downstream)
    if stats_drift is not None:
        f = f.join(stats_drift.select("asset_id", F.col("schema_drift").alias("stats_schema_drift")),
                   "asset_id", "left")
    else:
        f = f.withColumn("stats_schema_drift", F.lit(None).cast("boolean"))
    fired = [F.coalesce(r.condition, F.lit(False)).alias(f"r_{r.key}") for r in rules]
    f = f.select("*", *fired)
    raw = sum((F.when(F.col(f"r_{r.key}"), r.points).otherwise(0) for r in rules), F.lit(0))
    n_fired = sum((F.col(f"r_{r.key}").cast("int") for r in rules), F.lit(0))
    f = f.withColumn("raw_total", raw.cast("bigint")).withColumn("n_findings", n_fired.cast("bigint"))
    score = F.least(F.lit(fixed.SCORE_CAP), F.col("raw_total"))
    return (f.withColumn("score", score.cast("bigint"))
             .withColumn("risk_level", C.risk_level(score)))


def findings(cat: Catalog, downstream: DataFrame | None = None,
             threshold: int = fixed.DOWNSTREAM_THRESHOLD,
             rules: list[Rule] | None = None, facts: DataFrame | None = None) -> DataFrame:
    """One row per (asset, triggered rule), in fixed rule order.

    Columns: asset_id, asset_urn, asset_name, rule_order, rule, title, severity,
    points, detail. ``pos`` orders findings as the reference accumulates them
    (asset scan order, then rule order)."""
    rules = rules or default_rules(threshold)
    f = facts if facts is not None else scored_facts(cat, downstream, threshold, rules)
    items = F.array(*[
        F.struct(F.col(f"r_{r.key}").alias("on"), F.lit(i + 1).alias("rule_order"),
                 F.lit(r.key).alias("rule"), F.lit(r.title).alias("title"),
                 F.lit(r.severity).alias("severity"), F.lit(r.points).alias("points"),
                 r.detail.alias("detail"))
        for i, r in enumerate(rules)])
    out = f.select("asset_id", "urn", "display_name",
                   F.explode(F.filter(items, lambda x: x["on"])).alias("x"))
    return out.select(
        "asset_id", F.col("urn").alias("asset_urn"), F.col("display_name").alias("asset_name"),
        F.col("x.rule_order").alias("rule_order"), F.col("x.rule").alias("rule"),
        F.col("x.title").alias("title"), F.col("x.severity").alias("severity"),
        F.col("x.points").cast("bigint").alias("points"), F.col("x.detail").alias("detail"))


def written_facts(cat: Catalog, downstream: DataFrame | None = None, threshold: int = fixed.DOWNSTREAM_THRESHOLD) -> DataFrame:
    """``scored_facts`` as a table, computed once a catalogue and session. Everything that shows findings, scores or governance
    rows reads it with ``facts=``, and only the columns it needs."""
    key = (id(cat.assets), id(cat.schema_fields), id(downstream), threshold)
    hit = _FACTS.get(key)
    if hit is None:
        table = Workspace(cat.spark).table(scored_facts(cat, downstream, threshold), keep=True)
        hit = _FACTS[key] = (cat, downstream, table)
    return hit[2]


_FACTS: dict = {}


def rule_findings(cat: Catalog, rule: str, downstream: DataFrame | None = None,
                  threshold: int = fixed.DOWNSTREAM_THRESHOLD, facts: DataFrame | None = None) -> DataFrame:
    """One rule's findings only (R1-R6 individually)."""
    return findings(cat, downstream, threshold, facts=facts).where(F.col("rule") == rule)


def asset_risk_score(cat: Catalog, downstream: DataFrame | None = None,
                     threshold: int = fixed.DOWNSTREAM_THRESHOLD, facts: DataFrame | None = None) -> DataFrame:
    """A1 / A3: every asset's raw total, capped score and band (no findings -> 0, low)."""
    f = facts if facts is not None else scored_facts(cat, downstream, threshold)
    return f.select("asset_id", "urn", F.col("display_name").alias("name"), "raw_total",
                    "score", "risk_level", "n_findings")


def catalogue_verdict(cat: Catalog, downstream: DataFrame | None = None,
                      threshold: int = fixed.DOWNSTREAM_THRESHOLD, facts: DataFrame | None = None) -> DataFrame:
    """A2: the catalogue score is the worst asset's score; findings accumulate."""
    f = facts if facts is not None else scored_facts(cat, downstream, threshold)
    out = f.agg(F.coalesce(F.max("score"), F.lit(0)).cast("bigint").alias("score"),
                F.count(F.lit(1)).alias("assets_examined"),
                F.coalesce(F.sum("n_findings"), F.lit(0)).cast("bigint").alias("total_findings"),
                F.count_if(F.col("n_findings") > 0).alias("assets_with_findings"))
    return out.withColumn("risk_level", C.risk_level("score"))


def score_reconcile(cat: Catalog, stored: DataFrame, downstream: DataFrame | None = None,
                    threshold: int = fixed.DOWNSTREAM_THRESHOLD, facts: DataFrame | None = None) -> DataFrame:
    """Recompute each asset's score from its findings' points and keep the
    rows that disagree with the stored score (``stored``: asset_id, score)."""
    recomputed = (findings(cat, downstream, threshold, facts=facts).groupBy("asset_id")
                  .agg(F.sum("points").alias("raw_total"))
                  .select("asset_id", F.least(F.lit(fixed.SCORE_CAP), "raw_total").alias("recomputed")))
    s = stored.select("asset_id", F.col("score").alias("stored_score"))
    j = s.join(recomputed, "asset_id", "left").select(
        "asset_id", "stored_score", F.coalesce("recomputed", F.lit(0)).cast("bigint").alias("recomputed"))
    return j.where(F.col("stored_score") != F.col("recomputed"))


def evidence(cat: Catalog, downstream: DataFrame | None = None,
             threshold: int = fixed.DOWNSTREAM_THRESHOLD,
             root_totals: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """The compact evidence row per asset.

    Owner and tag lists stay in their long tables (J1, J3); the row carries the
    first owner, counts, the triggered rules (at most one per rule, so bounded)
    and - only on the traced root - the lineage totals."""
    f = facts if facts is not None else scored_facts(cat, downstream, threshold)
    rules = default_rules(threshold)
    triggered = F.filter(F.array(*[F.when(F.col(f"r_{r.key}"), F.lit(r.key)) for r in rules]),
                         lambda x: x.isNotNull())
    out = f.select(
        "asset_id", "name", "urn", "platform",
        F.col("owner").alias("first_owner"), F.col("owner_count").cast("bigint").alias("owner_count"),
        F.col("description").isNotNull().alias("has_description"),
        F.col("tag_count").cast("bigint").alias("tag_count"),
        triggered.alias("triggered_rules"), F.col("domain_name").alias("domain"))
    if root_totals is not None:
        out = out.join(root_totals.select(F.col("root").alias("asset_id"), "downstream_total",
                                          "upstream_total"), "asset_id", "left")
    else:
        out = (out.withColumn("downstream_total", F.lit(None).cast("bigint"))
               .withColumn("upstream_total", F.lit(None).cast("bigint")))
    parts = F.concat_ws(
        " · ",
        F.when(F.col("owner_count") > 0, C.template(fixed.EVIDENCE_OWNED, owner=F.coalesce("first_owner", F.lit("null"))))
         .otherwise(F.lit(fixed.EVIDENCE_NO_OWNER)),
        F.when(~F.col("has_description"), F.lit(fixed.EVIDENCE_UNDOCUMENTED)),
        F.when(F.col("downstream_total").isNotNull(),
               C.template(fixed.EVIDENCE_DOWNSTREAM, n=F.col("downstream_total"))))
    return out.withColumn("description_line",
                          F.when(parts == "", F.lit(fixed.EVIDENCE_NOTHING)).otherwise(parts))


def unowned_first(cat: Catalog) -> DataFrame:
    """Unowned-first stable ordering (scan order inside each group), as a rank."""
    from custos.functions.ranking import global_rank

    a = clean_assets(cat).select("asset_id", "urn")
    owned = owners_dedup(cat).select("asset_id").distinct().withColumn("o", F.lit(True))
    j = a.join(owned, "asset_id", "left").select(
        "asset_id", "urn", F.coalesce("o", F.lit(False)).alias("has_owner"))
    return global_rank(j, [F.col("has_owner").asc(), F.col("asset_id").asc()], "position")
