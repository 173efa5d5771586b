"""Roll-ups over assets, findings and run traces.

Global figures are single ``agg`` calls (partial aggregates per partition, one
tiny final merge); grouped figures are hash aggregates with map-side combine,
so a hot key (one owner of a third of all assets, one domain, one severity)
costs one partial row per map task. Fixed vocabularies (severity levels, rule
docs, actions, evidence sources) are literal arrays or tiny broadcast tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custos.functions import columns as C
from custos.functions import fixed
from custos.functions.ranking import global_rank
from custos.operators.assets import (clean_assets, domains_clean, governance_assets,
                                     owners_dedup, principals_clean)
from custos.sources.catalog import Catalog


def _levels(spark) -> DataFrame:
    return spark.createDataFrame([(lv, i) for i, lv in enumerate(fixed.SEVERITY_LEVELS)],
                                 "severity string, level_order int")


def round_avg(col) -> "F.Column":
    """Math.round(avg(x)) for non-negative whole numbers, exact: floor((2s + n) / 2n)."""
    s, n = F.sum(col), F.count(col)
    return F.when(n > 0, F.floor((s * 2 + n) / (n * 2))).cast("bigint")


# --- A4 / J6: owner facet ------------------------------------------------------------

def owner_facet(cat: Catalog, query: str = "*") -> DataFrame:
    """Distinct owners with the number of datasets each owns; dangling owners
    (no principal row) are kept with kind inferred from the URN."""
    # rows are unique by asset and owner already
    counts = owners_dedup(cat).groupBy("owner_urn").agg(F.count(F.lit(1)).alias("asset_count"))
    p = principals_clean(cat)
    out = counts.join(p, "owner_urn", "left").select(
        "owner_urn",
        F.coalesce("kind", C.owner_kind("owner_urn")).alias("kind"),
        "name", "display_name", "active", "asset_count",
        F.col("kind").isNull().alias("dangling"))
    q = (query or "").strip()
    if q and q != "*":
        hay = F.lower(F.concat_ws(" ", "owner_urn", "name", "display_name"))
        out = out.where(F.instr(hay, q.lower()) > 0)
    return out


# --- A5 / A6: domains ----------------------------------------------------------------

def domain_counts(cat: Catalog) -> DataFrame:
    """Every domain with its asset total (domains with no asset keep 0)."""
    per = clean_assets(cat).where(F.col("domain_urn").isNotNull()).groupBy("domain_urn").agg(
        F.count(F.lit(1)).alias("entity_count"))
    return domains_clean(cat).join(per, "domain_urn", "left").select(
        "domain_urn", "domain_name", F.coalesce("entity_count", F.lit(0)).cast("bigint").alias("entity_count"))


def domain_names(cat: Catalog) -> DataFrame:
    return domains_clean(cat).where(F.col("domain_name").isNotNull()).select(
        F.col("domain_name").alias("name"))


# --- A7 / A8 / F6: severity distribution -----------------------------------------------

def severity_counts(gov: DataFrame) -> DataFrame:
    """All four health-severity levels, present even at zero."""
    counts = gov.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(_levels(gov.sparkSession)).join(counts, "severity", "left")
            .select("severity", "level_order", F.coalesce("n", F.lit(0)).cast("bigint").alias("count")))


def severity_share(gov: DataFrame) -> DataFrame:
    """Share of each level in whole percent of all assets (0 when there are none)."""
    sc = severity_counts(gov)
    total = gov.select(F.count(F.lit(1))).scalar()
    return sc.select("severity", "level_order", "count", total.alias("total"),
                     F.coalesce(C.pct("count", total), F.lit(0)).alias("share"))


def severity_filter(gov: DataFrame, level: str = "critical") -> DataFrame:
    if level == "all":
        return gov
    return gov.where(F.col("severity") == level)


# --- A9 / G6: overview ---------------------------------------------------------------

def overview_metrics(cat: Catalog, gov: DataFrame, domain_counts_as_lineage: bool = False) -> DataFrame:
    """The ten overview figures in one aggregate (plus two scalar sub-queries for
    the owner and domain vocabularies)."""
    owners = cat.ownership.select(F.count_distinct(C.clean_text("owner_urn"))).scalar()
    domains = domains_clean(cat).select(F.count(F.lit(1))).scalar()
    connected = F.col("downstream_count") > 0
    if domain_counts_as_lineage:
        connected = connected | (F.col("domain") != "Unassigned")
    n = F.count(F.lit(1))
    return gov.agg(
        F.coalesce(round_avg("health"), F.lit(0)).alias("score"),
        n.alias("total_assets"),
        F.count_if(F.col("health") >= 80).alias("healthy_assets"),
        F.count_if(F.col("severity") == "critical").alias("critical_issues"),
        F.coalesce(round_avg("coverage"), F.lit(0)).alias("coverage"),
        F.coalesce(C.pct(F.count_if(F.col("description").isNotNull()), n), F.lit(0)).alias("documentation_coverage"),
        F.coalesce(C.pct(F.count_if(connected), n), F.lit(0)).alias("lineage_coverage"),
        F.count_if(F.col("owner").isNull()).alias("missing_owners"),
    ).select("*", owners.alias("owners"), domains.alias("domain_count"))


# --- A10 / A11 / A12: catalogue report ------------------------------------------------

def facet_coverage(gov: DataFrame) -> DataFrame:
    """Owner, documentation, tag and domain coverage: covered, total, percent
    (percent null on an empty catalogue)."""
    agg = gov.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("has_owner").alias("c_owner"),
        F.count_if("has_description").alias("c_doc"),
        F.count_if(F.col("tag_count") > 0).alias("c_tag"),
        F.count_if(F.col("domain") != "Unassigned").alias("c_domain"))
    long = agg.select("total", F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("ord"), F.lit(label).alias("label"), F.col(c).alias("covered"))
        for i, (label, c) in enumerate([("Ownership", "c_owner"), ("Documentation", "c_doc"),
                                        ("Tags", "c_tag"), ("Domain assignment", "c_domain")])])).alias("x"))
    return long.select(F.col("x.ord").alias("ord"), F.col("x.label").alias("label"),
                       F.col("x.covered").alias("covered"), "total",
                       C.pct("x.covered", "total").alias("percent"))


def platform_counts(cat: Catalog) -> DataFrame:
    a = clean_assets(cat).where(F.col("platform").isNotNull())
    return a.groupBy("platform").agg(F.count(F.lit(1)).alias("count"))


def entity_counts(cat: Catalog) -> DataFrame:
    """Datasets, owners, domains, platforms; null when not measurable (zero platforms)."""
    a = clean_assets(cat)
    owners = cat.ownership.select(F.count_distinct(C.clean_text("owner_urn"))).scalar()
    domains = domains_clean(cat).select(F.count(F.lit(1))).scalar()
    one = a.agg(F.count(F.lit(1)).alias("datasets"), F.count_distinct("platform").alias("platforms"))
    items = [("Datasets", F.col("datasets")), ("Owners", owners), ("Domains", domains),
             ("Platforms", F.nullif("platforms", F.lit(0)))]
    one = one.select(F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("ord"), F.lit(label).alias("label"), v.cast("bigint").alias("count"))
        for i, (label, v) in enumerate(items)])).alias("x"))
    return one.select("x.ord", "x.label", "x.count")


# --- A13 / W5: risk breakdown ----------------------------------------------------------

def risk_breakdown(findings: DataFrame) -> DataFrame:
    """Per asset (unattributed findings under one 'catalogue' bucket): raw total,
    capped score, level, capped flag, findings count; plus the worst-asset flag
    (max score, first-seen on ties) and the multi-asset flag, both from scalar
    sub-queries over the grouped frame."""
    key = F.coalesce("asset_urn", "asset_name", F.lit("catalogue"))
    g = findings.groupBy(key.alias("asset_key")).agg(
        F.min(F.struct("asset_id", "rule_order", "asset_name")).alias("first"),
        F.sum("points").cast("bigint").alias("raw_total"),
        F.count(F.lit(1)).alias("n_findings"))
    g = g.select("asset_key", F.coalesce("first.asset_name", F.lit("Catalogue-wide")).alias("asset_name"),
                 F.col("first.asset_id").alias("first_asset_id"), "raw_total", "n_findings")
    g = g.select("*", F.least(F.lit(fixed.SCORE_CAP), "raw_total").cast("bigint").alias("score"))
    g = g.select("*", C.risk_level("score").alias("risk_level"),
                 (F.col("raw_total") > F.col("score")).alias("capped"))
    worst = g.select(F.max(F.struct("score", (-F.coalesce("first_asset_id", F.lit(0))).alias("neg")))).scalar()
    n_assets = g.select(F.count(F.lit(1))).scalar()
    is_worst = ((F.col("score") == worst["score"])
                & (-F.coalesce("first_asset_id", F.lit(0)) == worst["neg"]))
    return g.select("asset_key", "asset_name", "raw_total", "score", "risk_level", "capped", "n_findings",
                    is_worst.alias("is_worst"), (n_assets > 1).alias("multi_asset"))


# --- A15 / A16 / W4 / F7 ------------------------------------------------------------------

def findings_by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))


def findings_by_title(findings: DataFrame) -> DataFrame:
    """Count per title plus its first-seen position (asset scan order, rule order)."""
    return findings.groupBy("title").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(F.struct("asset_id", "rule_order")).alias("first")).select(
        "title", "count", F.col("first.asset_id").alias("first_asset_id"),
        F.col("first.rule_order").alias("first_rule_order"))


def top_findings(findings: DataFrame, k: int = fixed.TOP_FINDINGS) -> DataFrame:
    """Top-k by points, stable (ties keep finding order); a distributed top-k."""
    return (findings.orderBy(F.desc("points"), "asset_id", "rule_order").limit(k)
            .select("asset_id", "asset_name", "rule", "title", "severity", "points"))


def alert_count(findings: DataFrame) -> DataFrame:
    return findings.agg(
        F.count_if(F.col("severity").isin("critical", "high")).alias("alerts"),
        F.count_if(F.col("severity") == "critical").alias("critical"))


def critical_findings(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity") == "critical")


# --- W7: top risk assets -----------------------------------------------------------------

def top_risk_assets(gov: DataFrame, k: int = fixed.TOP_RISK_ASSETS) -> DataFrame:
    """The k lowest-health assets (stable: scan order on ties)."""
    return gov.orderBy("health", "asset_id").limit(k).select("asset_id", "urn", "name", "health", "severity")


# --- A21: business impact -----------------------------------------------------------------

def business_impact(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count_if(F.col("n_findings") > 0).alias("affected_assets"),
        F.coalesce(F.sum(F.col("downstream_count")), F.lit(0)).cast("bigint").alias("downstream_consumers"),
        F.coalesce(F.sum("n_findings"), F.lit(0)).cast("bigint").alias("total_findings"))


# --- J8 / J10 / W3 / J9 ----------------------------------------------------------------------

def rule_docs_table(spark) -> DataFrame:
    rows = [(k, *v) for k, v in fixed.RULE_DOCS.items()]
    return spark.createDataFrame(rows, "rule string, rationale string, metadata_used string, consequence string")


def finding_rule_docs(findings: DataFrame) -> DataFrame:
    """Finding with its policy text; an unknown rule gets the generic text."""
    docs = rule_docs_table(findings.sparkSession)
    g = fixed.GENERIC_RULE_DOC
    return findings.join(F.broadcast(docs), "rule", "left").select(
        "asset_id", "rule", "title", "severity", "points",
        F.coalesce("rationale", F.lit(g[0])).alias("rationale"),
        F.coalesce("metadata_used", F.lit(g[1])).alias("metadata_used"),
        F.coalesce("consequence", F.lit(g[2])).alias("consequence"))


def actions_table(spark) -> DataFrame:
    rows = [(k, a, r) for k, (a, r) in fixed.FALLBACK_ACTIONS.items()]
    return spark.createDataFrame(rows, "rule string, action_text string, rationale string")


def recommendations(findings: DataFrame, k: int = fixed.MAX_RECOMMENDATIONS) -> DataFrame:
    """First finding per rule, ranked by points (first-seen on ties),
    top k, joined to its fixed corrective action (rules without one dropped)."""
    first = findings.groupBy("rule").agg(
        F.min(F.struct("asset_id", "rule_order", "asset_name", "asset_urn", "points", "severity")).alias("f"))
    first = first.select("rule", F.col("f.asset_id").alias("asset_id"), F.col("f.rule_order").alias("rule_order"),
                         F.col("f.asset_name").alias("asset_name"), F.col("f.asset_urn").alias("asset_urn"),
                         F.col("f.points").alias("points"), F.col("f.severity").alias("priority"))
    top = first.orderBy(F.desc("points"), "asset_id", "rule_order").limit(k)
    # k rows at most: a window over the top-k result is tiny.
    ranked = top.select("*", F.row_number().over(
        Window.orderBy(F.desc("points"), "asset_id", "rule_order")).alias("rank"))
    acts = F.broadcast(actions_table(findings.sparkSession))
    return ranked.join(acts, "rule", "inner").select(
        "rank", "rule",
        F.when(F.col("asset_name").isNotNull(), F.concat("action_text", F.lit(" for "), "asset_name"))
         .otherwise(F.col("action_text")).alias("action"),
        "rationale", "priority", "asset_urn",
        (F.col("rank") <= fixed.MAX_NEXT_STEPS).alias("next_step"))


def name_to_urn(names: DataFrame, findings: DataFrame) -> DataFrame:
    """Resolve names (column `name`) to a finding's URN, case-insensitive,
    first match in finding order; unknown names resolve to null."""
    first = (findings.where(F.col("asset_name").isNotNull())
             .groupBy(F.lower("asset_name").alias("lname"))
             .agg(F.min(F.struct("asset_id", "rule_order", "asset_urn")).alias("f"))
             .select("lname", F.col("f.asset_urn").alias("urn")))
    return names.join(first, F.lower(names.name) == first.lname, "left").select("name", "urn")


# --- J11 / A22: evidence completeness ---------------------------------------------------------

def evidence_completeness(run_trace: DataFrame) -> DataFrame:
    """Per run and evidence source: collected / not-required / unavailable from
    the last trace row of that node (absent or skipped = not-required)."""
    latest = run_trace.groupBy("run_id", "node").agg(
        F.max(F.struct("seq", "status")).alias("l")).select("run_id", "node", F.col("l.status").alias("status"))
    sources = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(n).alias("node"), F.lit(lbl).alias("label"))
                        for i, (n, lbl, _p) in enumerate(fixed.EVIDENCE_SOURCES)])
    runs = run_trace.select("run_id").distinct().select("run_id", F.explode(sources).alias("s"))
    runs = runs.select("run_id", F.col("s.ord").alias("ord"), F.col("s.node").alias("node"),
                       F.col("s.label").alias("label"))
    j = runs.join(latest, ["run_id", "node"], "left")
    state = (F.when(F.col("status").isNull() | (F.col("status") == "skipped"), "not-required")
             .when(F.col("status") == "failed", "unavailable").otherwise("collected"))
    return j.select("run_id", "ord", "node", "label", state.alias("state"))


def evidence_totals(run_trace: DataFrame) -> DataFrame:
    """Per run - collected and unavailable sources, degraded flag (any
    failed node), and the nodes that ran ok (a bounded vocabulary)."""
    ec = evidence_completeness(run_trace).groupBy("run_id").agg(
        F.count_if(F.col("state") == "collected").alias("collected"),
        F.count_if(F.col("state") == "unavailable").alias("unavailable"))
    degraded = run_trace.groupBy("run_id").agg(F.bool_or(F.col("status") == "failed").alias("degraded"))
    # nodes that ran ok, each once, in first-seen order (bounded by the node vocabulary)
    ok = (run_trace.where(F.col("status") == "ok").groupBy("run_id", "node").agg(F.min("seq").alias("s"))
          .groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("s", "node"))).alias("t"))
          .select("run_id", F.array_join(F.transform("t", lambda x: x["node"]), ",").alias("tools_used")))
    runs = degraded.join(ok, "run_id", "left").select(
        "run_id", "degraded", F.coalesce("tools_used", F.lit("")).alias("tools_used"))
    return ec.join(runs, "run_id", "inner")


# --- U1: notification feed ----------------------------------------------------------------------

def notification_feed(cat: Catalog, findings: DataFrame, gov: DataFrame) -> DataFrame:
    """Critical/high findings (stamped with the asset's last change) union the
    activity events, newest first (distributed global rank)."""
    alerts = findings.where(F.col("severity").isin("critical", "high")).join(
        gov.select("asset_id", "downstream_count", "last_modified"), "asset_id", "inner").select(
        F.concat(F.lit("alert-"), F.col("asset_id").cast("string"), F.lit("-"), F.col("rule")).alias("id"),
        F.col("last_modified").alias("timestamp"), "title",
        C.template(fixed.ALERT_DETAIL, asset=F.col("asset_name"), n=F.col("downstream_count")).alias("detail"),
        "severity", F.lit("finding").alias("kind"))
    act = cat.activity_events.select(
        F.concat(F.lit("activity-"), F.col("event_id").cast("string")).alias("id"),
        C.iso("ts").alias("timestamp"), "title", "kind")
    feed = alerts.unionByName(act, allowMissingColumns=True)
    return global_rank(feed, [F.col("timestamp").desc_nulls_last(), F.col("id").asc()], "feed_position")
