"""Named queries: ``(spark, sf_dir) -> DataFrame`` for every implemented operator.

Each one derives the catalogue from the test tables (lazily) and runs the
operator over the whole derived catalogue. Lineage-backed entries run the hop
loop (a few small jobs with reliable checkpoints) when the frame is built.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custos.operators import assets as A
from custos.operators import lineage as G
from custos.operators import rules as R
from custos.operators import search
from custos.sources.catalog import Catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def cat_of(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog.from_testdata(spark, sf_dir)


def _with_downstream(spark, sf_dir):
    cat = cat_of(spark, sf_dir)
    return cat, G.downstream_counts(cat)


def _facts(spark, sf_dir):
    cat, ds = _with_downstream(spark, sf_dir)
    return cat, R.written_facts(cat, ds)


# --- phase 1: cleaning -------------------------------------------------------------

@query("clean_assets")
def q_clean_assets(spark, sf_dir):
    a = A.clean_assets(cat_of(spark, sf_dir))
    from custos.functions.columns import iso
    return a.withColumns({"last_modified": iso("last_modified"), "last_ingested": iso("last_ingested")})


@query("effective_description")
def q_effective_description(spark, sf_dir):
    return A.effective_description(cat_of(spark, sf_dir))


@query("principals_clean")
def q_principals_clean(spark, sf_dir):
    return A.principals_clean(cat_of(spark, sf_dir))


@query("asset_tags_clean")
def q_asset_tags_clean(spark, sf_dir):
    return A.tags_clean(cat_of(spark, sf_dir))


@query("asset_attributes")
def q_asset_attributes(spark, sf_dir):
    return A.asset_attributes(cat_of(spark, sf_dir))


@query("schema_field_counts")
def q_schema_field_counts(spark, sf_dir):
    return A.schema_field_counts(cat_of(spark, sf_dir))


@query("asset_kind")
def q_asset_kind(spark, sf_dir):
    return A.asset_kind(cat_of(spark, sf_dir))


# --- phase 2: catalogue answers ------------------------------------------------------

@query("catalogue_scan")
def q_catalogue_scan(spark, sf_dir):
    return A.catalogue_scan(cat_of(spark, sf_dir))


@query("asset_owners")
def q_asset_owners(spark, sf_dir):
    return A.asset_owners(cat_of(spark, sf_dir))


@query("asset_domain")
def q_asset_domain(spark, sf_dir):
    return A.asset_domain(cat_of(spark, sf_dir))


@query("asset_tags")
def q_asset_tags(spark, sf_dir):
    return A.asset_tags(cat_of(spark, sf_dir))


@query("undocumented_assets")
def q_undocumented(spark, sf_dir):
    return A.undocumented_assets(cat_of(spark, sf_dir))


@query("unowned_assets")
def q_unowned(spark, sf_dir):
    return A.unowned_assets(cat_of(spark, sf_dir))


@query("owned_assets")
def q_owned(spark, sf_dir):
    return A.owned_assets(cat_of(spark, sf_dir))


# --- phase 3: lineage ----------------------------------------------------------------

@query("downstream_counts")
def q_downstream_counts(spark, sf_dir):
    return _with_downstream(spark, sf_dir)[1]


# --- phase 4: rules ------------------------------------------------------------------

@query("findings")
def q_findings(spark, sf_dir):
    return _fnd(spark, sf_dir)[1]


@query("asset_risk_score")
def q_asset_risk_score(spark, sf_dir):
    cat, facts = _facts(spark, sf_dir)
    return R.asset_risk_score(cat, facts=facts)


@query("catalogue_verdict")
def q_catalogue_verdict(spark, sf_dir):
    cat, facts = _facts(spark, sf_dir)
    return R.catalogue_verdict(cat, facts=facts)


@query("governance_assets")
def q_governance_assets(spark, sf_dir):
    return _gov(spark, sf_dir)[1]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


# --- phase 3b: rooted lineage ----------------------------------------------------------

ROOTED_MAX_HOPS = None  # rooted traversals run to the fixed point


@query("lineage_root")
def q_lineage_root(spark, sf_dir):
    return G.lineage_root(cat_of(spark, sf_dir))


def _hub(spark, sf_dir):
    cat, ds = _with_downstream(spark, sf_dir)
    return cat, G.blast_radius_hub(ds)


@query("lineage_downstream")
def q_lineage_downstream(spark, sf_dir):
    cat, hub = _hub(spark, sf_dir)
    return G.lineage_from_root(cat, "DOWNSTREAM", ROOTED_MAX_HOPS, hub)


@query("lineage_upstream")
def q_lineage_upstream(spark, sf_dir):
    cat, hub = _hub(spark, sf_dir)
    return G.lineage_from_root(cat, "UPSTREAM", ROOTED_MAX_HOPS, hub)


@query("lineage_impact")
def q_lineage_impact(spark, sf_dir):
    cat, hub = _hub(spark, sf_dir)
    return G.lineage_impact(cat, ROOTED_MAX_HOPS, hub)


@query("lineage_nodes")
def q_lineage_nodes(spark, sf_dir):
    cat, hub = _hub(spark, sf_dir)
    return G.lineage_graph(cat, ROOTED_MAX_HOPS, hub)[0]


@query("lineage_edges")
def q_lineage_edges(spark, sf_dir):
    cat, hub = _hub(spark, sf_dir)
    return G.lineage_graph(cat, ROOTED_MAX_HOPS, hub)[1]


@query("lineage_neighbours")
def q_lineage_neighbours(spark, sf_dir):
    cat, hub = _hub(spark, sf_dir)
    return G.lineage_neighbours(cat, hub.select(F.col("root").alias("node")))


# --- phase 5: roll-ups -------------------------------------------------------------------

from custos.operators import rollups as U  # noqa: E402


def _gov(spark, sf_dir):
    cat, facts = _facts(spark, sf_dir)
    return cat, A.governance_assets(cat, facts=facts)


def _fnd(spark, sf_dir):
    cat, facts = _facts(spark, sf_dir)
    return cat, R.findings(cat, facts=facts)


@query("owner_facet")
def q_owner_facet(spark, sf_dir):
    return U.owner_facet(cat_of(spark, sf_dir))


@query("domain_counts")
def q_domain_counts(spark, sf_dir):
    return U.domain_counts(cat_of(spark, sf_dir))


@query("domain_names")
def q_domain_names(spark, sf_dir):
    return U.domain_names(cat_of(spark, sf_dir))


@query("tag_list")
def q_tag_list(spark, sf_dir):
    return A.tag_list(cat_of(spark, sf_dir))


@query("asset_search")
def q_asset_search(spark, sf_dir):
    return A.asset_search(cat_of(spark, sf_dir), "Bolt")


@query("asset_search_ranked")
def q_asset_search_ranked(spark, sf_dir):
    return search.ranked(search.index_of(cat_of(spark, sf_dir)), "Blue Bolt")


@query("entity_search_ranked")
def q_entity_search_ranked(spark, sf_dir):
    return search.ranked(search.index_of(cat_of(spark, sf_dir)), "Team Supplier#0", ["CORP_USER", "CORP_GROUP", "DOMAIN", "TAG", "DATASET"])


@query("severity_counts")
def q_severity_counts(spark, sf_dir):
    return U.severity_counts(_gov(spark, sf_dir)[1])


@query("severity_share")
def q_severity_share(spark, sf_dir):
    return U.severity_share(_gov(spark, sf_dir)[1])


@query("severity_filter")
def q_severity_filter(spark, sf_dir):
    return U.severity_filter(_gov(spark, sf_dir)[1], "critical")


@query("overview_metrics")
def q_overview_metrics(spark, sf_dir):
    cat, gov = _gov(spark, sf_dir)
    return U.overview_metrics(cat, gov)


@query("facet_coverage")
def q_facet_coverage(spark, sf_dir):
    return U.facet_coverage(_gov(spark, sf_dir)[1])


@query("platform_counts")
def q_platform_counts(spark, sf_dir):
    return U.platform_counts(cat_of(spark, sf_dir))


@query("entity_counts")
def q_entity_counts(spark, sf_dir):
    return U.entity_counts(cat_of(spark, sf_dir))


@query("risk_breakdown")
def q_risk_breakdown(spark, sf_dir):
    return U.risk_breakdown(_fnd(spark, sf_dir)[1])


@query("findings_by_severity")
def q_findings_by_severity(spark, sf_dir):
    return U.findings_by_severity(_fnd(spark, sf_dir)[1])


@query("findings_by_title")
def q_findings_by_title(spark, sf_dir):
    return U.findings_by_title(_fnd(spark, sf_dir)[1])


@query("top_findings")
def q_top_findings(spark, sf_dir):
    return U.top_findings(_fnd(spark, sf_dir)[1])


@query("alert_count")
def q_alert_count(spark, sf_dir):
    return U.alert_count(_fnd(spark, sf_dir)[1])


@query("critical_findings")
def q_critical_findings(spark, sf_dir):
    return U.critical_findings(_fnd(spark, sf_dir)[1])


@query("top_risk_assets")
def q_top_risk_assets(spark, sf_dir):
    return U.top_risk_assets(_gov(spark, sf_dir)[1])


@query("business_impact")
def q_business_impact(spark, sf_dir):
    return U.business_impact(_facts(spark, sf_dir)[1])


@query("finding_rule_docs")
def q_finding_rule_docs(spark, sf_dir):
    return U.finding_rule_docs(_fnd(spark, sf_dir)[1])


@query("recommendations")
def q_recommendations(spark, sf_dir):
    return U.recommendations(_fnd(spark, sf_dir)[1])


@query("name_to_urn")
def q_name_to_urn(spark, sf_dir):
    cat, f = _fnd(spark, sf_dir)
    names = A.clean_assets(cat).select(F.upper("display_name").alias("name")).distinct()
    return U.name_to_urn(names, f)


@query("evidence_completeness")
def q_evidence_completeness(spark, sf_dir):
    return U.evidence_completeness(cat_of(spark, sf_dir).run_trace)


@query("evidence_totals")
def q_evidence_totals(spark, sf_dir):
    return U.evidence_totals(cat_of(spark, sf_dir).run_trace)


@query("notification_feed")
def q_notification_feed(spark, sf_dir):
    cat, facts = _facts(spark, sf_dir)
    return U.notification_feed(cat, R.findings(cat, facts=facts), A.governance_assets(cat, facts=facts))


@query("asset_page")
def q_asset_page(spark, sf_dir):
    return A.asset_page(_gov(spark, sf_dir)[1].select("asset_id", "urn", "name", "health"), 40, 25)


@query("governance_sorted")
def q_governance_sorted(spark, sf_dir):
    g = _gov(spark, sf_dir)[1].select("asset_id", "urn", "name", "owner", "health", "severity")
    return A.governance_sorted(g, "health", "asc")


@query("unowned_first")
def q_unowned_first(spark, sf_dir):
    return R.unowned_first(cat_of(spark, sf_dir))


@query("evidence")
def q_evidence(spark, sf_dir):
    cat, facts = _facts(spark, sf_dir)
    totals = G.lineage_totals(cat, G.lineage_root(cat).select("root"), ROOTED_MAX_HOPS)
    return R.evidence(cat, root_totals=totals, facts=facts)


# --- phase 6: profiling and usage ------------------------------------------------------------

from custos.operators import profile as P  # noqa: E402
from custos.operators import usage as S  # noqa: E402


@query("column_profile")
def q_column_profile(spark, sf_dir):
    return P.profile_tables(spark, sf_dir)


ALL_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@query("column_profile_merged")
def q_column_profile_merged(spark, sf_dir):
    """Every column of all 14 tables, from the merged profiles of their files (the exact figures; the sketches' are in ``merge``)."""
    import uuid

    from custos.operators.sketch_profile import ProfileTable
    from custos.session import ensure_checkpoint_dir

    table = ProfileTable(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/custos-profiles-{uuid.uuid4().hex[:12]}")
    for name in ALL_TABLES:
        table.update(name, spark.read.parquet(f"{sf_dir}/{name}.parquet").inputFiles())
    number = lambda c: F.when(F.col("kind").isin("integer", "real"), F.col(c) + 0.0).alias(c)
    return table.profile().select("table_name", "column_name", "row_count", "null_count", number("min"), number("max"),
                                  F.round(number("mean"), 4).alias("mean"))


@query("profile_history")
def q_profile_history(spark, sf_dir):
    return P.profile_history(cat_of(spark, sf_dir), 3)


@query("profile_latest")
def q_profile_latest(spark, sf_dir):
    return P.profile_latest(cat_of(spark, sf_dir))


@query("usage_summary")
def q_usage_summary(spark, sf_dir):
    return S.usage_summary(cat_of(spark, sf_dir), "WEEK")


@query("usage_top_users")
def q_usage_top_users(spark, sf_dir):
    return S.usage_top_users(cat_of(spark, sf_dir), 3, "MONTH")


@query("usage_buckets")
def q_usage_buckets(spark, sf_dir):
    return S.usage_buckets(cat_of(spark, sf_dir), "WEEK")


@query("usage_fields")
def q_usage_fields(spark, sf_dir):
    return S.usage_fields(cat_of(spark, sf_dir), "MONTH")


@query("statistics_summary")
def q_statistics_summary(spark, sf_dir):
    return S.statistics_summary(cat_of(spark, sf_dir), "MONTH")


# --- phase 7: questions --------------------------------------------------------------------

from custos.operators import questions as Q  # noqa: E402


@query("question_intent")
def q_question_intent(spark, sf_dir):
    return Q.question_intent(cat_of(spark, sf_dir).questions)


@query("question_target")
def q_question_target(spark, sf_dir):
    return Q.question_target(cat_of(spark, sf_dir).questions)


@query("question_plan")
def q_question_plan(spark, sf_dir):
    return Q.question_plan(cat_of(spark, sf_dir).questions)


# --- phase 7b: reports and sinks -------------------------------------------------------------

from custos.operators import reports as T  # noqa: E402


@query("scan_summary")
def q_scan_summary(spark, sf_dir):
    cat, facts = _facts(spark, sf_dir)
    return T.scan_summary(facts, R.findings(cat, facts=facts))


def owners_per_domain(cat, gov):
    o = A.owners_dedup(cat).join(gov.select("asset_id", "domain"), "asset_id", "inner")
    return o.groupBy("domain").agg(F.count_distinct("owner_urn").alias("owners"))


@query("scan_brief")
def q_scan_brief(spark, sf_dir):
    cat, gov = _gov(spark, sf_dir)
    n_domains = A.domains_clean(cat).select(F.count(F.lit(1))).scalar()
    return T.scan_brief(gov, owners_per_domain(cat, gov), n_domains)


@query("executive_report")
def q_executive_report(spark, sf_dir):
    cat, facts = _facts(spark, sf_dir)
    f = R.findings(cat, facts=facts)
    return T.executive_report(R.catalogue_verdict(cat, facts=facts), f, U.recommendations(f),
                              "Which datasets are highest risk?", "find_risky_datasets")


@query("assessment_report")
def q_assessment_report(spark, sf_dir):
    """The whole assessment, with the stages of the run that has the smallest number."""
    cat, facts = _facts(spark, sf_dir)
    f = R.findings(cat, facts=facts)
    first = cat.run_trace.select(F.min("run_id")).scalar()
    run = T.Run("Which datasets are highest risk?", "find_risky_datasets", "2024-01-01T00:00:00.000Z", 1116.4, "rules", True,
                "Governance needs attention.", "Defects spread downstream.", ("lineage timed out",))
    return T.assessment_report(R.catalogue_verdict(cat, facts=facts), f, U.recommendations(f), cat.run_trace.where(F.col("run_id") == first), run)


@query("data_dictionary")
def q_data_dictionary(spark, sf_dir):
    return T.data_dictionary(cat_of(spark, sf_dir))


@query("run_steps")
def q_run_steps(spark, sf_dir):
    return T.run_steps(cat_of(spark, sf_dir).run_trace)


@query("findings_json")
def q_findings_json(spark, sf_dir):
    return T.to_json_lines(_fnd(spark, sf_dir)[1])


# --- phase 8: sinks and history ----------------------------------------------------------------

from custos.operators import detail  # noqa: E402
from custos.operators import history as H  # noqa: E402
from custos.operators import intervals  # noqa: E402


@query("aspect_upsert")
def q_aspect_upsert(spark, sf_dir):
    return H.latest_aspects(H.aspect_events(cat_of(spark, sf_dir)))


def _two_scans(spark, sf_dir):
    """Findings of the previous scan (previous schema snapshot) and the current one."""
    cat, ds = _with_downstream(spark, sf_dir)
    prev = R.findings(cat.with_tables(schema_fields=cat.schema_fields_prev), ds)
    return prev, _fnd(spark, sf_dir)[1]


@query("risk_trend")
def q_risk_trend(spark, sf_dir):
    prev, curr = _two_scans(spark, sf_dir)
    return H.risk_trend(H.findings_history(prev, curr, "previous", "current"))


@query("finding_diff")
def q_finding_diff(spark, sf_dir):
    return H.finding_diff(*_two_scans(spark, sf_dir))


def _scans(spark, sf_dir):
    """Yearly scans derived from the line items: (scans, schema fields seen, findings seen).

    A part's second field is seen in the years in which it was shipped, its id is an INT until 1997 for every eighth part, and every
    tenth has a legacy code until 1996. In a year without shipments it has no owner; a personal-data column without a
    sensitivity tag is a finding as long as it is seen."""
    from custos.functions import columns as C

    cat = cat_of(spark, sf_dir)
    year = F.year("l_shipdate")
    seen = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_shipdate is not null").select(
        F.col("l_partkey").alias("asset_id"), F.concat(year.cast("string"), F.lit("-12-31")).alias("scan")).distinct()
    scans = seen.select("scan").distinct()
    ids = cat.assets.select("asset_id")
    years = F.array(*[F.lit(r[0]) for r in scans.orderBy("scan").collect()]).cast("array<string>")  # one a scan
    every = ids.withColumn("scan", F.explode(years))
    first = every.select("asset_id", F.lit("id").alias("field_path"), F.when(
        (F.col("asset_id") % 8 == 0) & (F.col("scan") < "1998"), "INT").otherwise("BIGINT").alias("native_data_type"), "scan")
    second = cat.schema_fields.where("pos = 2").select("asset_id", "field_path", "native_data_type").join(seen, "asset_id")
    legacy = every.where((F.col("asset_id") % 10 == 0) & (F.col("scan") < "1997")).select(
        "asset_id", F.lit("legacy_code").alias("field_path"), F.lit("VARCHAR").alias("native_data_type"), "scan")
    unowned = every.join(seen, ["asset_id", "scan"], "left_anti").select(
        "asset_id", "scan", F.lit("missing_owner").alias("rule"), F.lit("high").alias("severity"))
    tagged = A.tag_stats(cat).where("has_pii_tag").select("asset_id")
    personal = second.where(C.looks_like_pii("field_path")).join(tagged, "asset_id", "left_anti").select(
        "asset_id", "scan", F.lit("untagged_pii").alias("rule"), F.lit("critical").alias("severity"))
    return scans, first.unionByName(second).unionByName(legacy), unowned.unionByName(personal)


def _schema_history(spark, sf_dir):
    scans, fields, _ = _scans(spark, sf_dir)
    return intervals.from_scans(fields, scans, ["asset_id", "field_path"], ["native_data_type"])


def _detail(name, operator):
    def run(spark, sf_dir):
        return operator(cat_of(spark, sf_dir))
    QUERIES[name] = run


for _name, _operator in (("principal_details", detail.principal_details), ("asset_terms", detail.asset_terms), ("asset_links", detail.asset_links),
                         ("asset_properties", detail.asset_properties), ("asset_deprecations", detail.deprecations), ("schema_detail", detail.schema_detail),
                         ("asset_detail", detail.asset_detail), ("tag_vocabulary", detail.tag_vocabulary), ("domain_detail", detail.domain_detail),
                         ("domain_owners", detail.domain_owner_list)):
    _detail(_name, _operator)


@query("dataset_owners")
def q_dataset_owners(spark, sf_dir):
    """Owners of the deprecated datasets, asked for by URN."""
    cat = cat_of(spark, sf_dir)
    return detail.dataset_owners(cat, A.clean_assets(cat).where("deprecated").select("urn"))


@query("risk_incremental")
def q_risk_incremental(spark, sf_dir):
    """Scores after two batches on a table that began with the previous schema and the edges of the first line numbers:
    first the other edges come, then the current schema."""
    import uuid

    from custos.session import ensure_checkpoint_dir
    from custos.streaming.rescore import ScoreTable

    cat = cat_of(spark, sf_dir)
    first = F.col("dst") - 2 * F.col("src") <= 39
    table = ScoreTable(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/custos-scores-{uuid.uuid4().hex[:12]}")
    before = cat.with_tables(schema_fields=cat.schema_fields_prev)
    table.start(before.with_tables(lineage_edges=cat.lineage_edges.where(first)))
    table.apply(before, cat.assets.select("asset_id").where(F.lit(False)), cat.lineage_edges.where(~first))
    table.apply(cat, H.schema_diff(cat).select("asset_id").distinct())
    return table.scores(findings=False)


@query("schema_history")
def q_schema_history(spark, sf_dir):
    return _schema_history(spark, sf_dir)


@query("schema_as_of")
def q_schema_as_of(spark, sf_dir):
    return intervals.as_of(_schema_history(spark, sf_dir), "1997-06-30")


@query("drift_history")
def q_drift_history(spark, sf_dir):
    return intervals.changes(_schema_history(spark, sf_dir), ["asset_id", "field_path"], ["native_data_type"]).select(
        "asset_id", "field_path", "at", "change", F.col("before.native_data_type").alias("before"), F.col("after.native_data_type").alias("after"))


@query("risk_trend_history")
def q_risk_trend_history(spark, sf_dir):
    from custos.functions import fixed

    scans, _, found = _scans(spark, sf_dir)
    history = intervals.from_scans(found, scans, ["asset_id", "rule"], ["severity"])
    return intervals.risk_by_scan(history, scans, fixed.SEVERITY_LEVELS)


@query("profile_schema_as_of")
def q_profile_schema_as_of(spark, sf_dir):
    """Each profile with the type that the asset's second field had when it was made."""
    rows = cat_of(spark, sf_dir).profiles.select("asset_id", F.date_format("profiled_at", "yyyy-MM-dd").alias("day"), "row_count")
    second = _schema_history(spark, sf_dir).where("field_path not in ('id', 'legacy_code')")
    return intervals.as_of_join(rows, second, ["asset_id"], "day")


@query("schema_diff")
def q_schema_diff(spark, sf_dir):
    return H.schema_diff(cat_of(spark, sf_dir))


@query("stale_assets")
def q_stale_assets(spark, sf_dir):
    return H.stale_assets(cat_of(spark, sf_dir), 30)


# --- remaining inventory keys ------------------------------------------------------------------

def requested_urns(cat):
    """URNs asked for in bulk: the assets referenced by usage events, plus a
    placeholder URN for event asset ids that have no asset (the not-found case)."""
    ids = cat.usage_events.select("asset_id").distinct()
    a = A.clean_assets(cat).select("asset_id", "urn")
    return ids.join(a, "asset_id", "left").select(
        F.coalesce("urn", F.concat(F.lit("urn:li:dataset:missing_"), F.col("asset_id").cast("string"))).alias("urn"))


@query("dataset_detail")
def q_dataset_detail(spark, sf_dir):
    cat = cat_of(spark, sf_dir)
    return A.dataset_detail(cat, requested_urns(cat))


@query("dataset_schema")
def q_dataset_schema(spark, sf_dir):
    cat = cat_of(spark, sf_dir)
    return A.dataset_schema(cat, requested_urns(cat))


def _rule(rule):
    def run(spark, sf_dir):
        cat, facts = _facts(spark, sf_dir)
        return R.rule_findings(cat, rule, facts=facts)
    return run


for _key, _rule_name in [("rule_missing_owner", "missing_owner"),
                         ("rule_missing_documentation", "missing_documentation"),
                         ("rule_untagged_pii", "untagged_pii"),
                         ("rule_large_downstream", "large_downstream_impact"),
                         ("rule_deprecated_in_use", "deprecated_in_use"),
                         ("rule_schema_drift", "schema_drift")]:
    QUERIES[_key] = _rule(_rule_name)


@query("pii_columns")
def q_pii_columns(spark, sf_dir):
    return R.pii_columns(cat_of(spark, sf_dir))


@query("pii_tagged_assets")
def q_pii_tagged_assets(spark, sf_dir):
    return R.pii_tagged_assets(cat_of(spark, sf_dir))


@query("score_reconcile")
def q_score_reconcile(spark, sf_dir):
    """Scores stored by the previous scan (previous schema snapshot) checked
    against the scores recomputed from the current findings."""
    cat, ds = _with_downstream(spark, sf_dir)
    stored = R.asset_risk_score(cat.with_tables(schema_fields=cat.schema_fields_prev), ds)
    return R.score_reconcile(cat, stored.select("asset_id", "score"), facts=_facts(spark, sf_dir)[1])


@query("downstream_counts_approx")
def q_downstream_counts_approx(spark, sf_dir):
    """G3 by HLL sketches merged along edges (approximate; no SQL oracle)."""
    return G.downstream_counts_approx(cat_of(spark, sf_dir))


@query("raw_documents")
def q_raw_documents(spark, sf_dir):
    """S2 over whole tables: documents rendered from the derived catalogue,
    parsed back under the explicit schema, flattened and cleaned."""
    from custos.functions.columns import iso
    from custos.sources import raw as W

    parsed = W.parse_raw(W.render_documents(cat_of(spark, sf_dir)))
    a = A.clean_assets(W.catalog_from_raw(parsed))
    return a.select("urn", "name", "display_name", "platform", "description", "deprecated",
                    "domain_urn", iso("last_modified").alias("last_modified"))
