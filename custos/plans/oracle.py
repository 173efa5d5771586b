"""DuckDB oracle SQL per registered query (same column names as the Spark side)."""

from __future__ import annotations

from custos.plans.oracle_base import PII_RE as PII_RE_SQL, with_ctes

W = with_ctes()

ORACLE: dict[str, str] = {}


def sql(name: str, body: str, extra: str = "") -> None:
    ORACLE[name] = (with_ctes(extra) if extra else W) + body


# --- phase 1 ---------------------------------------------------------------------
sql("clean_assets", """
SELECT asset_id, urn, name, display_name, platform, description, deprecated, domain_urn, schema_drift,
 strftime(last_modified, '%Y-%m-%dT%H:%M:%S') AS last_modified, strftime(last_ingested, '%Y-%m-%dT%H:%M:%S') AS last_ingested,
 qualified_name, external_url, sub_types FROM ca""")

sql("effective_description", "SELECT asset_id, urn, description FROM ca")

sql("principals_clean", """
SELECT owner_urn, CASE WHEN starts_with(owner_urn, 'urn:li:corpuser:') THEN 'USER'
 WHEN starts_with(owner_urn, 'urn:li:corpGroup:') THEN 'GROUP' ELSE 'UNKNOWN' END AS kind,
 name, display_name, active FROM pc""")

sql("asset_tags_clean", """
SELECT asset_id, 'urn:li:tag:' || tag AS tag_urn, tag FROM asset_tags""")

sql("asset_attributes", """
SELECT asset_id, urn, platform,
 CASE WHEN platform IN ('dbt','airflow','spark','kafka') THEN 'pipeline'
      WHEN platform IN ('looker','tableau','powerbi','superset') THEN 'dashboard' ELSE 'dataset' END AS kind,
 string_split(string_split(regexp_extract(urn, '\\(([^)]*)\\)', 1), ',')[2], '.')[-1] AS short_name,
 domain_urn, deprecated FROM ca""")

sql("schema_field_counts", """
SELECT ca.asset_id, ca.urn, CAST(COALESCE(c.n, 0) AS BIGINT) AS field_count
FROM ca LEFT JOIN (SELECT asset_id, count(*) AS n FROM schema_fields WHERE field_path IS NOT NULL GROUP BY asset_id) c USING (asset_id)""")

sql("asset_kind", """
SELECT asset_id, urn, COALESCE(NULLIF(regexp_extract(urn, 'dataPlatform:([a-zA-Z0-9_-]+)', 1), ''), 'unknown') AS urn_platform,
 string_split(string_split(regexp_extract(urn, '\\(([^)]*)\\)', 1), ',')[2], '.')[-1] AS short_name,
 CASE WHEN regexp_extract(urn, 'dataPlatform:([a-zA-Z0-9_-]+)', 1) IN ('dbt','airflow','spark','kafka') THEN 'pipeline'
      WHEN regexp_extract(urn, 'dataPlatform:([a-zA-Z0-9_-]+)', 1) IN ('looker','tableau','powerbi','superset') THEN 'dashboard' ELSE 'dataset' END AS kind
FROM ca""")

# --- phase 2 ---------------------------------------------------------------------
sql("catalogue_scan", """
SELECT asset_id, urn, name, display_name, platform, description, domain_urn, domain_name,
 CAST(owner_count AS BIGINT) AS owner_count, owner, CAST(tag_count AS BIGINT) AS tag_count, deprecated,
 strftime(last_modified, '%Y-%m-%dT%H:%M:%S') AS last_modified, strftime(last_ingested, '%Y-%m-%dT%H:%M:%S') AS last_ingested,
 qualified_name, external_url, sub_types FROM facts""")

sql("asset_owners", """
SELECT ca.asset_id, ca.urn, od.owner_urn, od.pos, od.ownership_type,
 CASE WHEN od.owner_urn IS NULL THEN NULL WHEN starts_with(od.owner_urn, 'urn:li:corpuser:') THEN 'USER'
      WHEN starts_with(od.owner_urn, 'urn:li:corpGroup:') THEN 'GROUP' ELSE 'UNKNOWN' END AS kind,
 pc.name, pc.display_name, pc.active
FROM ca LEFT JOIN od USING (asset_id) LEFT JOIN pc ON pc.owner_urn = od.owner_urn""")

sql("asset_domain", """
SELECT ca.asset_id, ca.urn, ca.domain_urn, dc.domain_name FROM ca LEFT JOIN dc ON dc.domain_urn = ca.domain_urn""")

sql("asset_tags", """
SELECT ca.asset_id, ca.urn, CASE WHEN t.tag IS NOT NULL THEN 'urn:li:tag:' || t.tag END AS tag_urn, t.tag
FROM ca LEFT JOIN asset_tags t USING (asset_id)""")

sql("undocumented_assets", "SELECT asset_id, urn, name FROM ca WHERE description IS NULL")
sql("unowned_assets", "SELECT asset_id, urn, name FROM ca WHERE asset_id NOT IN (SELECT asset_id FROM od)")
sql("owned_assets", "SELECT asset_id, urn, name FROM ca WHERE asset_id IN (SELECT asset_id FROM od)")

# --- phase 3 ---------------------------------------------------------------------
sql("downstream_counts", "SELECT asset_id, downstream_count FROM ds")

# --- phase 4 ---------------------------------------------------------------------
sql("findings", """
SELECT asset_id, asset_urn, asset_name, rule_order, rule, title, severity, CAST(points AS BIGINT) AS points, detail FROM fnd""")

sql("asset_risk_score", """
SELECT asset_id, urn, display_name AS name, CAST(raw_total AS BIGINT) AS raw_total, CAST(score AS BIGINT) AS score,
 risk_level, CAST(n_findings AS BIGINT) AS n_findings FROM risk""")

sql("catalogue_verdict", """
SELECT CAST(COALESCE(max(score), 0) AS BIGINT) AS score, count(*) AS assets_examined,
 CAST(COALESCE(sum(n_findings), 0) AS BIGINT) AS total_findings, count_if(n_findings > 0) AS assets_with_findings,
 CASE WHEN COALESCE(max(score), 0) >= 70 THEN 'critical' WHEN COALESCE(max(score), 0) >= 40 THEN 'high'
      WHEN COALESCE(max(score), 0) >= 20 THEN 'medium' ELSE 'low' END AS risk_level FROM risk""")

sql("governance_assets", """
SELECT asset_id, urn, name, platform, domain, owner, has_owner, has_description, deprecated,
 CAST(tag_count AS BIGINT) AS tag_count, CAST(coverage AS BIGINT) AS coverage, CAST(documentation AS BIGINT) AS documentation,
 CAST(health AS BIGINT) AS health, severity, CAST(downstream_count AS BIGINT) AS downstream_count, last_modified, description
FROM govr""")


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# --- rooted lineage (W6 root, recursion to the fixed point) ------------------------
W6ROOT = """
w6 AS (
 SELECT asset_id AS root, urn AS root_urn, asset_id IN (SELECT asset_id FROM od) AS has_owner FROM ca
 ORDER BY has_owner, asset_id LIMIT 1),
w6dn(node, degree) AS (
 SELECT e.dst, 1 FROM lineage_edges e JOIN w6 ON e.src = w6.root WHERE e.dst <> w6.root
 UNION
 SELECT e.dst, r.degree + 1 FROM w6dn r JOIN lineage_edges e ON e.src = r.node JOIN w6 ON e.dst <> w6.root),
w6up(node, degree) AS (
 SELECT e.src, 1 FROM lineage_edges e JOIN w6 ON e.dst = w6.root WHERE e.src <> w6.root
 UNION
 SELECT e.src, r.degree + 1 FROM w6up r JOIN lineage_edges e ON e.dst = r.node JOIN w6 ON e.src <> w6.root)"""

ROOT = """
droot AS (
 SELECT ds.asset_id AS root, ca.urn AS root_urn FROM ds JOIN ca USING (asset_id)
 ORDER BY ds.downstream_count DESC, ds.asset_id LIMIT 1),
dn(node, degree) AS (
 SELECT e.dst, 1 FROM lineage_edges e JOIN droot ON e.src = droot.root WHERE e.dst <> droot.root
 UNION
 SELECT e.dst, r.degree + 1 FROM dn r JOIN lineage_edges e ON e.src = r.node JOIN droot ON e.dst <> droot.root),
up(node, degree) AS (
 SELECT e.src, 1 FROM lineage_edges e JOIN droot ON e.dst = droot.root WHERE e.src <> droot.root
 UNION
 SELECT e.src, r.degree + 1 FROM up r JOIN lineage_edges e ON e.dst = r.node JOIN droot ON e.src <> droot.root),
dnodes AS (
 SELECT droot.root, d.node, ca.urn AS node_urn, ca.name AS node_name, 'DATASET' AS entity_type, ca.platform,
  d.degree, ca.deprecated, 'DOWNSTREAM' AS direction
 FROM (SELECT node, min(degree) AS degree FROM dn GROUP BY node) d JOIN ca ON ca.asset_id = d.node JOIN droot ON TRUE),
unodes AS (
 SELECT droot.root, d.node, ca.urn AS node_urn, ca.name AS node_name, 'DATASET' AS entity_type, ca.platform,
  d.degree, ca.deprecated, 'UPSTREAM' AS direction
 FROM (SELECT node, min(degree) AS degree FROM up GROUP BY node) d JOIN ca ON ca.asset_id = d.node JOIN droot ON TRUE),
impact AS (
 SELECT b.*, count(*) OVER (PARTITION BY b.direction) AS direction_total
 FROM (SELECT * FROM dnodes UNION ALL SELECT * FROM unodes) b)"""

sql("lineage_root", "SELECT root, root_urn, has_owner FROM w6", W6ROOT)
sql("lineage_downstream", "SELECT * FROM dnodes", ROOT)
sql("lineage_upstream", "SELECT * FROM unodes", ROOT)
sql("lineage_impact", "SELECT * FROM impact", ROOT)

KIND = """CASE WHEN lower({p}) IN ('dbt','airflow','spark','kafka') THEN 'pipeline'
 WHEN lower({p}) IN ('looker','tableau','powerbi','superset') THEN 'dashboard' ELSE 'dataset' END"""

sql("lineage_nodes", """
SELECT node_urn AS id, CASE WHEN direction = 'UPSTREAM' THEN 0 ELSE 2 END AS "column",
 COALESCE(node_name, string_split(string_split(regexp_extract(node_urn, '\\(([^)]*)\\)', 1), ',')[2], '.')[-1]) AS name,
 COALESCE(platform, 'unknown') AS platform, """ + KIND.format(p="COALESCE(platform, 'unknown')") + """ AS kind,
 CASE WHEN deprecated THEN 'high' ELSE 'low' END AS severity,
 CASE WHEN deprecated THEN 'Marked deprecated but still present in this lineage path.'
      ELSE 'dataset at hop ' || CAST(degree AS VARCHAR) || ' from the traced asset.' END AS summary,
 FALSE AS is_root, direction, root
FROM impact
UNION ALL
SELECT root_urn, 1, string_split(string_split(regexp_extract(root_urn, '\\(([^)]*)\\)', 1), ',')[2], '.')[-1],
 COALESCE(NULLIF(regexp_extract(root_urn, 'dataPlatform:([a-zA-Z0-9_-]+)', 1), ''), 'unknown'), 'dataset', 'medium',
 'The asset this lineage was traced from.', TRUE, NULL, root
FROM droot""", ROOT)

sql("lineage_edges", """
SELECT CASE WHEN direction = 'UPSTREAM' THEN node_urn || '->' || droot.root_urn ELSE droot.root_urn || '->' || node_urn END AS id,
 CASE WHEN direction = 'UPSTREAM' THEN node_urn ELSE droot.root_urn END AS source,
 CASE WHEN direction = 'UPSTREAM' THEN droot.root_urn ELSE node_urn END AS target
FROM impact JOIN droot ON TRUE""", ROOT)

sql("lineage_neighbours", """
SELECT x.asset_id, ca.urn FROM (
 SELECT src AS asset_id FROM lineage_edges, droot WHERE src = droot.root OR dst = droot.root
 UNION SELECT dst FROM lineage_edges, droot WHERE src = droot.root OR dst = droot.root) x
LEFT JOIN ca USING (asset_id)""", ROOT)

# --- roll-ups ---------------------------------------------------------------------
sql("owner_facet", """
SELECT c.owner_urn, CASE WHEN starts_with(c.owner_urn, 'urn:li:corpuser:') THEN 'USER'
 WHEN starts_with(c.owner_urn, 'urn:li:corpGroup:') THEN 'GROUP' ELSE 'UNKNOWN' END AS kind,
 pc.name, pc.display_name, pc.active, c.asset_count, pc.owner_urn IS NULL AS dangling
FROM (SELECT owner_urn, count(DISTINCT asset_id) AS asset_count FROM od GROUP BY owner_urn) c
LEFT JOIN pc ON pc.owner_urn = c.owner_urn""")

sql("domain_counts", """
SELECT dc.domain_urn, dc.domain_name, CAST(COALESCE(n.c, 0) AS BIGINT) AS entity_count
FROM dc LEFT JOIN (SELECT domain_urn, count(*) AS c FROM ca WHERE domain_urn IS NOT NULL GROUP BY domain_urn) n
 ON n.domain_urn = dc.domain_urn""")

sql("domain_names", "SELECT domain_name AS name FROM dc WHERE domain_name IS NOT NULL")

sql("tag_list", """
SELECT 'urn:li:tag:' || tag AS tag_urn, tag, count(DISTINCT asset_id) AS asset_count FROM asset_tags GROUP BY tag""")

sql("asset_search", """
SELECT asset_id, urn, name, platform FROM ca
WHERE instr(lower(concat_ws(' ', display_name, urn, description)), 'bolt') > 0""")

_SEARCHED = """ent AS (
 SELECT 'DATASET' AS entity_type, urn AS entity_urn, asset_id, display_name AS name, platform, urn, description FROM ca
 UNION ALL SELECT 'DOMAIN', domain_urn, NULL, domain_name, NULL, domain_urn, NULL FROM dc
 UNION ALL SELECT DISTINCT 'TAG', 'urn:li:tag:' || tag, NULL, tag, NULL, 'urn:li:tag:' || tag, NULL FROM asset_tags
 UNION ALL SELECT CASE WHEN starts_with(owner_urn, 'urn:li:corpGroup:') THEN 'CORP_GROUP' ELSE 'CORP_USER' END, owner_urn, NULL, display_name, NULL, owner_urn, NULL FROM pc),
say AS (
 SELECT entity_type, entity_urn, w, unnest(list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS token
 FROM (SELECT entity_type, entity_urn, 4 AS w, name AS t FROM ent UNION ALL SELECT entity_type, entity_urn, 2, description FROM ent UNION ALL SELECT entity_type, entity_urn, 1, urn FROM ent)),
len AS (SELECT entity_type, entity_urn, count(*) AS length FROM say GROUP BY ALL),
tok AS (SELECT token, entity_type, entity_urn, sum(w)::DOUBLE AS tf FROM say WHERE token IN ({words}) GROUP BY ALL),
n AS (SELECT (SELECT count(*) FROM ent)::DOUBLE AS docs, (SELECT count(*) FROM say)::DOUBLE AS total),
df AS (SELECT token, count(*)::DOUBLE AS d FROM tok GROUP BY token),
bm AS (SELECT entity_type, entity_urn, sum(ln(1 + (docs - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (total / docs)))) AS score
 FROM tok JOIN df USING (token) JOIN len USING (entity_type, entity_urn), n GROUP BY ALL),
found AS (SELECT ent.entity_type, ent.entity_urn, asset_id, name, platform, round(coalesce(score, 0.0), 6) AS score FROM ent LEFT JOIN bm USING (entity_type, entity_urn)
 WHERE instr(lower(concat_ws(' ', name, urn, description)), '{query}') > 0 AND ent.entity_type IN ({types}))"""


def _ranked(query: str, words: list[str], types: list[str]) -> str:
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    return _SEARCHED.format(query=query, words=quoted(words), types=quoted(types))


_RANK = """SELECT row_number() OVER (ORDER BY score DESC, entity_urn, entity_type) AS position, entity_type, entity_urn, asset_id, name, platform, score FROM found"""
sql("asset_search_ranked", _RANK, _ranked("blue bolt", ["blue", "bolt"], ["DATASET"]))
sql("entity_search_ranked", _RANK, _ranked("team supplier#0", ["0", "supplier", "team"], ["CORP_USER", "CORP_GROUP", "DOMAIN", "TAG", "DATASET"]))

LEVELS = """lv(severity, level_order) AS (VALUES ('critical', 0), ('high', 1), ('medium', 2), ('low', 3)),
sc AS (SELECT lv.severity, lv.level_order, CAST(COALESCE(c.n, 0) AS BIGINT) AS count
 FROM lv LEFT JOIN (SELECT severity, count(*) AS n FROM govr GROUP BY severity) c ON c.severity = lv.severity)"""

sql("severity_counts", "SELECT * FROM sc", LEVELS)
sql("severity_share", """
SELECT severity, level_order, count, (SELECT count(*) FROM govr) AS total,
 COALESCE(CASE WHEN (SELECT count(*) FROM govr) > 0 THEN CAST(floor((count * 200 + (SELECT count(*) FROM govr)) / ((SELECT count(*) FROM govr) * 2)) AS BIGINT) END, 0) AS share
FROM sc""", LEVELS)
sql("severity_filter", """
SELECT asset_id, urn, name, platform, domain, owner, has_owner, has_description, deprecated,
 CAST(tag_count AS BIGINT) AS tag_count, CAST(coverage AS BIGINT) AS coverage, CAST(documentation AS BIGINT) AS documentation,
 CAST(health AS BIGINT) AS health, severity, CAST(downstream_count AS BIGINT) AS downstream_count, last_modified, description
FROM govr WHERE severity = 'critical'""")


def _pct(c, t):
    return f"CASE WHEN {t} > 0 THEN CAST(floor(({c} * 200 + {t}) / ({t} * 2)) AS BIGINT) END"


sql("overview_metrics", f"""
SELECT COALESCE(CAST(floor((sum(health) * 2 + count(*)) / (count(*) * 2)) AS BIGINT), 0) AS score,
 count(*) AS total_assets, count_if(health >= 80) AS healthy_assets, count_if(severity = 'critical') AS critical_issues,
 COALESCE(CAST(floor((sum(coverage) * 2 + count(*)) / (count(*) * 2)) AS BIGINT), 0) AS coverage,
 COALESCE({_pct("count_if(description IS NOT NULL)", "count(*)")}, 0) AS documentation_coverage,
 COALESCE({_pct("count_if(downstream_count > 0)", "count(*)")}, 0) AS lineage_coverage,
 count_if(owner IS NULL) AS missing_owners,
 (SELECT count(DISTINCT owner_urn) FROM od) AS owners, (SELECT count(*) FROM dc) AS domain_count
FROM govr""")

sql("facet_coverage", f"""
SELECT ord, label, covered, total, {_pct("covered", "total")} AS percent FROM (
 SELECT 1 AS ord, 'Ownership' AS label, count_if(has_owner) AS covered, count(*) AS total FROM govr
 UNION ALL SELECT 2, 'Documentation', count_if(has_description), count(*) FROM govr
 UNION ALL SELECT 3, 'Tags', count_if(tag_count > 0), count(*) FROM govr
 UNION ALL SELECT 4, 'Domain assignment', count_if(domain <> 'Unassigned'), count(*) FROM govr)""")

sql("platform_counts", "SELECT platform, count(*) AS count FROM ca WHERE platform IS NOT NULL GROUP BY platform")

sql("entity_counts", """
SELECT 1 AS ord, 'Datasets' AS label, CAST(count(*) AS BIGINT) AS count FROM ca
UNION ALL SELECT 2, 'Owners', CAST(count(DISTINCT owner_urn) AS BIGINT) FROM od
UNION ALL SELECT 3, 'Domains', CAST(count(*) AS BIGINT) FROM dc
UNION ALL SELECT 4, 'Platforms', CAST(NULLIF(count(DISTINCT platform), 0) AS BIGINT) FROM ca""")

sql("risk_breakdown", """
SELECT asset_key, asset_name, raw_total, score,
 CASE WHEN score >= 70 THEN 'critical' WHEN score >= 40 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END AS risk_level,
 raw_total > score AS capped, n_findings,
 row_number() OVER (ORDER BY score DESC, first_asset_id) = 1 AS is_worst,
 count(*) OVER () > 1 AS multi_asset
FROM (SELECT COALESCE(asset_urn, asset_name, 'catalogue') AS asset_key,
  COALESCE((list(asset_name ORDER BY asset_id, rule_order))[1], 'Catalogue-wide') AS asset_name,
  min(asset_id) AS first_asset_id, CAST(sum(points) AS BIGINT) AS raw_total, count(*) AS n_findings,
  CAST(least(100, sum(points)) AS BIGINT) AS score
 FROM fnd GROUP BY 1)""")

sql("findings_by_severity", "SELECT severity, count(*) AS count FROM fnd GROUP BY severity")
sql("findings_by_title", """
SELECT title, count(*) AS count, (list(asset_id ORDER BY asset_id, rule_order))[1] AS first_asset_id,
 (list(rule_order ORDER BY asset_id, rule_order))[1] AS first_rule_order FROM fnd GROUP BY title""")
sql("top_findings", """
SELECT asset_id, asset_name, rule, title, severity, CAST(points AS BIGINT) AS points FROM fnd
ORDER BY points DESC, asset_id, rule_order LIMIT 8""")
sql("alert_count", """
SELECT count_if(severity IN ('critical', 'high')) AS alerts, count_if(severity = 'critical') AS critical FROM fnd""")
sql("critical_findings", """
SELECT asset_id, asset_urn, asset_name, rule_order, rule, title, severity, CAST(points AS BIGINT) AS points, detail
FROM fnd WHERE severity = 'critical'""")
sql("top_risk_assets", """
SELECT asset_id, urn, name, CAST(health AS BIGINT) AS health, severity FROM govr ORDER BY health, asset_id LIMIT 6""")
sql("business_impact", """
SELECT count_if(n_findings > 0) AS affected_assets, CAST(COALESCE(sum(downstream), 0) AS BIGINT) AS downstream_consumers,
 CAST(COALESCE(sum(n_findings), 0) AS BIGINT) AS total_findings FROM risk""")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


from custos.functions import fixed  # noqa: E402

DOCS = "docs(rule, rationale, metadata_used, consequence) AS (VALUES " + ", ".join(
    f"({_q(k)}, {_q(a)}, {_q(b)}, {_q(c)})" for k, (a, b, c) in fixed.RULE_DOCS.items()) + ")"
G0, G1_, G2 = fixed.GENERIC_RULE_DOC
sql("finding_rule_docs", f"""
SELECT f.asset_id, f.rule, f.title, f.severity, CAST(f.points AS BIGINT) AS points,
 COALESCE(d.rationale, {_q(G0)}) AS rationale, COALESCE(d.metadata_used, {_q(G1_)}) AS metadata_used,
 COALESCE(d.consequence, {_q(G2)}) AS consequence
FROM fnd f LEFT JOIN docs d ON d.rule = f.rule""", DOCS)

ACTS = "acts(rule, action_text, rationale) AS (VALUES " + ", ".join(
    f"({_q(k)}, {_q(a)}, {_q(r)})" for k, (a, r) in fixed.FALLBACK_ACTIONS.items()) + ")"
sql("recommendations", """
SELECT t.rank, t.rule, CASE WHEN t.asset_name IS NOT NULL THEN a.action_text || ' for ' || t.asset_name ELSE a.action_text END AS action,
 a.rationale, t.priority, t.asset_urn, t.rank <= 3 AS next_step
FROM (SELECT *, row_number() OVER (ORDER BY points DESC, asset_id, rule_order) AS rank FROM (
  SELECT rule, (list(asset_id ORDER BY asset_id, rule_order))[1] AS asset_id, min(rule_order) AS rule_order,
   (list(asset_name ORDER BY asset_id, rule_order))[1] AS asset_name, (list(asset_urn ORDER BY asset_id, rule_order))[1] AS asset_urn,
   (list(points ORDER BY asset_id, rule_order))[1] AS points, (list(severity ORDER BY asset_id, rule_order))[1] AS priority
  FROM fnd GROUP BY rule)) t JOIN acts a ON a.rule = t.rule
WHERE t.rank <= 5""", ACTS)

sql("name_to_urn", """
SELECT n.name, f.urn FROM (SELECT DISTINCT upper(display_name) AS name FROM ca) n
LEFT JOIN (SELECT lower(asset_name) AS lname, (list(asset_urn ORDER BY asset_id, rule_order))[1] AS urn
 FROM fnd WHERE asset_name IS NOT NULL GROUP BY 1) f ON lower(n.name) = f.lname""")

EC = """
latest AS (SELECT run_id, node, (list(status ORDER BY seq DESC, status DESC))[1] AS status FROM run_trace GROUP BY run_id, node),
src(ord, node, label) AS (VALUES (1, 'datasets', 'Schema & tags'), (2, 'owners', 'Ownership'), (3, 'lineage', 'Lineage'), (4, 'statistics', 'Usage & profiling')),
ec AS (
 SELECT r.run_id, src.ord, src.node, src.label,
  CASE WHEN l.status IS NULL OR l.status = 'skipped' THEN 'not-required' WHEN l.status = 'failed' THEN 'unavailable' ELSE 'collected' END AS state
 FROM (SELECT DISTINCT run_id FROM run_trace) r CROSS JOIN src LEFT JOIN latest l ON l.run_id = r.run_id AND l.node = src.node)"""
sql("evidence_completeness", "SELECT * FROM ec", EC)
sql("evidence_totals", """
SELECT e.run_id, e.collected, e.unavailable, r.degraded, r.tools_used FROM
 (SELECT run_id, count_if(state = 'collected') AS collected, count_if(state = 'unavailable') AS unavailable FROM ec GROUP BY run_id) e
 JOIN (SELECT run_id, bool_or(status = 'failed') AS degraded,
   COALESCE((SELECT array_to_string(list(o.node ORDER BY o.s, o.node), ',') FROM
     (SELECT node, min(seq) AS s FROM run_trace t2 WHERE t2.run_id = run_trace.run_id AND t2.status = 'ok' GROUP BY node) o), '') AS tools_used
  FROM run_trace GROUP BY run_id) r USING (run_id)""", EC)

sql("notification_feed", """
SELECT *, row_number() OVER (ORDER BY timestamp DESC NULLS LAST, id) AS feed_position FROM (
 SELECT 'alert-' || CAST(f.asset_id AS VARCHAR) || '-' || f.rule AS id, g.last_modified AS timestamp, f.title,
  f.asset_name || ' · ' || CAST(g.downstream_count AS VARCHAR) || ' downstream' AS detail, f.severity, 'finding' AS kind
 FROM fnd f JOIN govr g USING (asset_id) WHERE f.severity IN ('critical', 'high')
 UNION ALL
 SELECT 'activity-' || CAST(event_id AS VARCHAR), strftime(ts, '%Y-%m-%dT%H:%M:%S'), title, NULL, NULL, kind FROM activity_events)""")

sql("asset_page", """
SELECT asset_id, urn, name, CAST(health AS BIGINT) AS health, rn - 1 AS row_index, 40 AS page_start, 25 AS page_count,
 (SELECT count(*) FROM govr) AS total, 65 < (SELECT count(*) FROM govr) AS has_more
FROM (SELECT *, row_number() OVER (ORDER BY name NULLS FIRST, urn NULLS FIRST) AS rn FROM govr) WHERE rn > 40 AND rn <= 65""")

sql("governance_sorted", """
SELECT asset_id, urn, name, owner, CAST(health AS BIGINT) AS health, severity,
 row_number() OVER (ORDER BY health, urn) AS sort_rank FROM govr""")

sql("unowned_first", """
SELECT asset_id, urn, has_owner, row_number() OVER (ORDER BY has_owner, asset_id) AS position
FROM (SELECT asset_id, urn, asset_id IN (SELECT asset_id FROM od) AS has_owner FROM ca)""")

sql("evidence", """
SELECT r.asset_id, r.name, r.urn, r.platform, r.owner AS first_owner, CAST(r.owner_count AS BIGINT) AS owner_count,
 r.description IS NOT NULL AS has_description, CAST(r.tag_count AS BIGINT) AS tag_count,
 list_filter([CASE WHEN r_missing_owner THEN 'missing_owner' END, CASE WHEN r_missing_documentation THEN 'missing_documentation' END,
  CASE WHEN r_untagged_pii THEN 'untagged_pii' END, CASE WHEN r_large_downstream_impact THEN 'large_downstream_impact' END,
  CASE WHEN r_deprecated_in_use THEN 'deprecated_in_use' END, CASE WHEN r_schema_drift THEN 'schema_drift' END], lambda x: x IS NOT NULL) AS triggered_rules,
 r.domain_name AS domain, t.downstream_total, t.upstream_total,
 COALESCE(NULLIF(concat_ws(' · ', CASE WHEN r.owner_count > 0 THEN 'owned by ' || COALESCE(r.owner, 'null') ELSE 'no owner' END,
  CASE WHEN r.description IS NULL THEN 'undocumented' END,
  CASE WHEN t.downstream_total IS NOT NULL THEN CAST(t.downstream_total AS VARCHAR) || ' downstream' END), ''), 'no issues found') AS description_line
FROM risk r LEFT JOIN (SELECT w6.root,
  (SELECT count(DISTINCT node) FROM w6dn) AS downstream_total,
  (SELECT count(DISTINCT node) FROM w6up) AS upstream_total FROM w6) t ON t.root = r.asset_id""", W6ROOT)


# --- profiling and usage -----------------------------------------------------------
# FIXED VALUES: the column lists of the profiled test tables, in schema order.
PROFILED = {
    "customer": [("c_custkey", "n"), ("c_name", "s"), ("c_nationkey", "n"), ("c_acctbal", "n"),
                 ("c_mktsegment", "s")],
    "orders": [("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "s"), ("o_totalprice", "n"),
               ("o_orderdate", "t"), ("o_orderpriority", "s")],
    "lineitem": [("l_orderkey", "n"), ("l_partkey", "n"), ("l_suppkey", "n"), ("l_linenumber", "n"),
                 ("l_quantity", "n"), ("l_extendedprice", "n"), ("l_discount", "n"), ("l_tax", "n"),
                 ("l_returnflag", "s"), ("l_linestatus", "s"), ("l_shipdate", "t")],
}


def _profile_sql() -> str:
    parts = []
    for table, cols in PROFILED.items():
        for i, (c, kind) in enumerate(cols):
            if kind == "t":
                mn, mx = f"strftime(min({c}), '%Y-%m-%d %H:%M:%S')", f"strftime(max({c}), '%Y-%m-%d %H:%M:%S')"
            else:
                mn, mx = f"CAST(min({c}) AS VARCHAR)", f"CAST(max({c}) AS VARCHAR)"
            num = kind == "n"
            parts.append(
                f"SELECT '{table}' AS table_name, {i + 1} AS pos, '{c}' AS column_name, count(*) AS row_count, "
                f"{len(cols)} AS column_count, count(*) - count({c}) AS null_count, "
                f"CASE WHEN count(*) > 0 THEN (count(*) - count({c})) / count(*) END AS null_proportion, "
                f"count(DISTINCT {c}) AS unique_count, "
                f"CASE WHEN count({c}) > 0 THEN count(DISTINCT {c}) / count({c}) END AS unique_proportion, "
                f"{mn} AS min, {mx} AS max, "
                + (f"round(avg({c}::DOUBLE), 4) AS mean, median({c}::DOUBLE) AS median, round(stddev_samp({c}::DOUBLE), 4) AS stdev"
                   if num else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS stdev")
                + f" FROM {table}")
    return "\nUNION ALL ".join(parts)


ORACLE["column_profile"] = _profile_sql()

sql("profile_history", """
SELECT asset_id, snapshot, strftime(profiled_at, '%Y-%m-%dT%H:%M:%S') AS profiled_at, row_count, size_in_bytes FROM (
 SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY profiled_at DESC NULLS LAST, row_count DESC, size_in_bytes DESC) AS snapshot
 FROM profiles) WHERE snapshot <= 3""")

sql("profile_latest", """
SELECT asset_id, strftime(profiled_at, '%Y-%m-%dT%H:%M:%S') AS profiled_at, row_count, size_in_bytes FROM (
 SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY profiled_at IS NOT NULL DESC, profiled_at DESC, row_count DESC, size_in_bytes DESC) AS rn
 FROM profiles) WHERE rn = 1""")


def _range(days: int) -> str:
    return (f"rng AS (SELECT * FROM usage_events WHERE ts > (SELECT max(ts) FROM usage_events) - INTERVAL {days} DAY "
            f"AND ts <= (SELECT max(ts) FROM usage_events))")


sql("usage_summary", """
SELECT asset_id, 'WEEK' AS time_range, count(*) AS total_queries, count(DISTINCT user_urn) AS unique_users,
 CAST(NULL AS VARCHAR) AS usage_unavailable_reason FROM rng GROUP BY asset_id""", _range(7))

sql("usage_top_users", """
SELECT asset_id, user_rank, user_urn, split_part(user_urn, ':', 4) AS username, query_count FROM (
 SELECT asset_id, user_urn, count(*) AS query_count,
  row_number() OVER (PARTITION BY asset_id ORDER BY count(*) DESC, user_urn) AS user_rank
 FROM rng GROUP BY asset_id, user_urn) WHERE user_rank <= 3""", _range(30))

sql("usage_buckets", """
SELECT asset_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS bucket, count(*) AS total_queries, count(DISTINCT user_urn) AS unique_users
FROM rng GROUP BY asset_id, CAST(ts AS DATE)""", _range(7))

sql("usage_fields", """
SELECT asset_id, field_name, count(*) AS count FROM rng WHERE field_name IS NOT NULL GROUP BY asset_id, field_name""", _range(30))

sql("statistics_summary", """
SELECT ca.asset_id, ca.urn, l.profiled_at IS NOT NULL AS profiled, COALESCE(sc.column_count, 0) AS column_count, l.row_count, l.size_in_bytes,
 strftime(l.profiled_at, '%Y-%m-%dT%H:%M:%S') AS profiled_at, TRUE AS usage_available,
 COALESCE(u.total_queries, 0) AS total_queries, COALESCE(u.unique_users, 0) AS unique_users,
 CAST(NULL AS VARCHAR) AS usage_unavailable_reason, 'MONTH' AS time_range
FROM ca LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY profiled_at IS NOT NULL DESC,
  profiled_at DESC, row_count DESC, size_in_bytes DESC) AS rn FROM profiles) WHERE rn = 1) l USING (asset_id)
LEFT JOIN (SELECT asset_id, count(*) AS total_queries, count(DISTINCT user_urn) AS unique_users FROM rng GROUP BY asset_id) u USING (asset_id)
LEFT JOIN (SELECT asset_id, count(*) AS column_count FROM schema_fields WHERE NULLIF(trim(field_path), '') IS NOT NULL GROUP BY asset_id) sc USING (asset_id)""",
    _range(30))


# --- questions (T1-T3) -------------------------------------------------------------


def _list(vals) -> str:
    return "[" + ", ".join(_q(v) for v in vals) + "]"


def _questions_cte() -> str:
    parts = []
    for order, (intent, kws, excl, weight) in enumerate(fixed.INTENT_RULES):
        hits = f"list_filter({_list(kws)}, lambda k: contains(low, k))"
        if excl:
            hits = f"CASE WHEN len(list_filter({_list(excl)}, lambda k: contains(low, k))) > 0 THEN []::VARCHAR[] ELSE {hits} END"
        parts.append(f"{{'score': {weight} * len({hits}), 'neg': {-order}, 'intent': {_q(intent)}, 'hits': {hits}}}")
    stop = _list(fixed.NAME_STOPWORDS)
    nodes_case = "CASE intent " + " ".join(
        f"WHEN {_q(k)} THEN {_list(v)}" for k, v in fixed.INTENT_NODES.items()) + f" ELSE {_list(fixed.INTENT_NODES['unknown'])} END"
    return f"""
qt AS (SELECT question_id, NULLIF(trim(question), '') AS text, lower(NULLIF(trim(question), '')) AS low FROM questions),
qs AS (SELECT *, list_filter([{', '.join(parts)}], lambda s: s.score > 0) AS arr FROM qt),
qr AS (SELECT *, list_sort(arr, 'DESC') AS ranked FROM qs),
qi AS (
 SELECT question_id, text, low,
  CASE WHEN text IS NULL OR len(arr) = 0 THEN 'unknown' ELSE ranked[1].intent END AS intent,
  CASE WHEN text IS NULL OR len(arr) = 0 THEN FALSE ELSE ranked[1].score >= 2 AND ranked[1].score > COALESCE(ranked[2].score, 0) END AS confident,
  CASE WHEN text IS NULL THEN 'Empty question.' WHEN len(arr) = 0 THEN 'No governance keywords matched.'
       ELSE 'Matched ''' || array_to_string(list_sort(ranked[1].hits), ', ') || ''' → ' || ranked[1].intent || '.' END AS reason,
  NULLIF(regexp_extract(text, {_q(fixed.URN_PATTERN)}, 0), '') AS target_urn
 FROM qr),
qn AS (
 SELECT *, CASE WHEN target_urn IS NULL AND text IS NOT NULL THEN
   list_filter(regexp_extract_all(low, {_q(fixed.NAME_PATTERN)}, 1),
     lambda c: NOT list_contains({stop}, split_part(c, '.', 1)) AND (contains(c, '_') OR contains(c, '.')))[1] END AS target_name
 FROM qi),
qp0 AS (SELECT *, {nodes_case} AS base, target_urn IS NOT NULL OR target_name IS NOT NULL AS has_target FROM qn),
qp1 AS (SELECT *, CASE WHEN has_target AND NOT list_contains(base, 'lineage') AND list_contains(base, 'risk')
   THEN list_concat(base[1:list_position(base, 'risk') - 1], ['lineage'], base[list_position(base, 'risk'):]) ELSE base END AS b1 FROM qp0),
qp AS (SELECT *, array_to_string(CASE WHEN intent IN ({', '.join(_q(i) for i in fixed.RECOMMEND_FOR)}) AND NOT list_contains(b1, 'recommendation')
   THEN list_concat(b1, ['recommendation']) ELSE b1 END, ',') AS plan FROM qp1)"""


QCTE = _questions_cte()
sql("question_intent", "SELECT question_id, intent, confident, reason FROM qp", QCTE)
sql("question_target", "SELECT question_id, target_urn, target_name FROM qp", QCTE)
sql("question_plan", "SELECT question_id, intent, plan FROM qp", QCTE)


# --- reports ---------------------------------------------------------------------------
BR = """
tb AS (SELECT COALESCE(r.domain_name, 'Unassigned') AS domain, f.title, count(*) AS n,
  min(f.asset_id * 10 + f.rule_order) AS first FROM fnd f JOIN risk r USING (asset_id) GROUP BY 1, 2),
tball AS (SELECT '*' AS domain, title, count(*) AS n, min(asset_id * 10 + rule_order) AS first FROM fnd GROUP BY title),
brk AS (SELECT domain, string_agg(title || ' (' || CAST(n AS VARCHAR) || ')', '; ' ORDER BY first) AS breakdown
  FROM (SELECT * FROM tb UNION ALL SELECT * FROM tball) GROUP BY domain),
sm AS (
 SELECT COALESCE(domain_name, 'Unassigned') AS domain, count(*) AS assets, COALESCE(max(score), 0) AS score, sum(n_findings) AS n_findings
 FROM risk GROUP BY 1
 UNION ALL SELECT '*', count(*), COALESCE(max(score), 0), COALESCE(sum(n_findings), 0) FROM risk),
sm2 AS (SELECT sm.*, brk.breakdown, CASE WHEN score >= 70 THEN 'critical' WHEN score >= 40 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END AS lvl
 FROM sm LEFT JOIN brk USING (domain))"""
sql("scan_summary", """
SELECT domain, CAST(assets AS BIGINT) AS assets, CAST(score AS BIGINT) AS score, lvl AS risk_level,
 CAST(COALESCE(n_findings, 0) AS BIGINT) AS findings,
 CASE WHEN COALESCE(n_findings, 0) = 0 THEN 'Examined ' || CAST(assets AS VARCHAR) || ' asset(s) and found no rule violations. Risk level ' || lvl || ' (score ' || CAST(score AS VARCHAR) || ').'
  ELSE 'Examined ' || CAST(assets AS VARCHAR) || ' asset(s) and found ' || CAST(n_findings AS VARCHAR) || ' rule violation(s): ' || breakdown || '. Risk level ' || lvl || ' (score ' || CAST(score AS VARCHAR) || '). AI explanation was unavailable, so this summary is generated directly from the rule engine.' END AS summary,
 CASE WHEN COALESCE(n_findings, 0) = 0 THEN 'No governance issues were detected in this scan.'
  ELSE 'Findings are listed below with the rule each one triggered. Review them directly — the narrative explanation could not be generated.' END AS business_impact
FROM sm2""", BR)

BRIEF = """
opd AS (SELECT g.domain, count(DISTINCT od.owner_urn) AS owners FROM od JOIN govr g USING (asset_id) GROUP BY g.domain),
dm AS (
 SELECT g.domain, CAST(floor((sum(health) * 2 + count(*)) / (count(*) * 2)) AS BIGINT) AS score, count(*) AS total_assets,
  count_if(health >= 80) AS healthy_assets, count_if(severity = 'critical') AS crit, count_if(owner IS NULL) AS miss,
  CAST(floor((count_if(description IS NOT NULL) * 200 + count(*)) / (count(*) * 2)) AS BIGINT) AS doc,
  COALESCE(max(opd.owners), 0) AS owner_count
 FROM govr g LEFT JOIN opd USING (domain) GROUP BY g.domain),
dm2 AS (SELECT *, format('{:,}', total_assets) || ' ' || CASE WHEN total_assets = 1 THEN 'asset' ELSE 'assets' END AS assets_txt,
  (SELECT count(*) FROM dc) AS dcount FROM dm),
acts AS (
 SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY k) AS ord, label, prompt FROM (
  SELECT domain, 1 AS k, 'Investigate critical risks' AS label, 'Which datasets are highest risk?' AS prompt FROM dm2 WHERE crit > 0
  UNION ALL SELECT domain, 2, 'Review ' || CAST(miss AS VARCHAR) || ' unowned ' || CASE WHEN miss = 1 THEN 'asset' ELSE 'assets' END, 'Find datasets without owners' FROM dm2 WHERE miss > 0
  UNION ALL SELECT domain, 3, 'Scan for untagged PII', 'Find untagged PII across all datasets' FROM dm2
  UNION ALL SELECT domain, 4, 'Generate executive report', 'Create a governance report' FROM dm2))"""
sql("scan_brief", """
SELECT domain, 'headline' AS kind, 0 AS ord,
 CASE WHEN crit > 0 THEN 'I analysed ' || assets_txt || ' and found ' || CAST(crit AS VARCHAR) || ' at critical risk. Ownership and classification gaps are the largest contributors.'
  WHEN miss > 0 THEN 'I analysed ' || assets_txt || '. Nothing is at critical risk, but ' || CAST(miss AS VARCHAR) || ' ' || CASE WHEN miss = 1 THEN 'asset has' ELSE 'assets have' END || ' no accountable owner.'
  WHEN doc < 80 THEN 'I analysed ' || assets_txt || '. Ownership is complete; documentation coverage is ' || CAST(doc AS VARCHAR) || '% and is now the weakest signal.'
  ELSE 'I analysed ' || assets_txt || ' and found no critical governance gaps. Metadata health is ' || CAST(score AS VARCHAR) || '/100.' END AS text,
 NULL AS detail, NULL AS tone FROM dm2
UNION ALL SELECT domain, 'finding', 1, CAST(crit AS VARCHAR) || ' critical ' || CASE WHEN crit = 1 THEN 'risk' ELSE 'risks' END,
 CASE WHEN crit > 0 THEN 'Assets with health below 40 on the governance score' ELSE 'No asset has health below 40' END,
 CASE WHEN crit > 0 THEN 'critical' ELSE 'positive' END FROM dm2
UNION ALL SELECT domain, 'finding', 2, CAST(miss AS VARCHAR) || ' without an owner',
 CASE WHEN miss > 0 THEN 'No accountable responder when these break' ELSE 'All assets have an owner across ' || CAST(owner_count AS VARCHAR) || ' people and groups' END,
 CASE WHEN miss > 0 THEN 'warning' ELSE 'positive' END FROM dm2
UNION ALL SELECT domain, 'finding', 3, CAST(doc AS VARCHAR) || '% documented',
 'Assets carrying a description · ' || CAST(dcount AS VARCHAR) || ' business ' || CASE WHEN dcount = 1 THEN 'domain' ELSE 'domains' END,
 CASE WHEN doc >= 80 THEN 'positive' ELSE 'warning' END FROM dm2
UNION ALL SELECT domain, 'finding', 4, CAST(score AS VARCHAR) || '/100 metadata health',
 'Composite of ownership, documentation, and classification · ' || CAST(healthy_assets AS VARCHAR) || ' assets above 80',
 CASE WHEN score >= 80 THEN 'positive' WHEN score >= 50 THEN 'warning' ELSE 'critical' END FROM dm2
UNION ALL SELECT domain, 'action', ord, label, prompt, NULL FROM acts WHERE ord <= 4""", BRIEF)

sql("data_dictionary", """
SELECT ca.asset_id, x.line_no, x.line FROM ca LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY profiled_at IS NOT NULL DESC,
  profiled_at DESC, row_count DESC, size_in_bytes DESC) AS rn FROM profiles) WHERE rn = 1) l USING (asset_id),
 LATERAL (SELECT unnest([-4, -3, -2, -1, 0]) AS line_no, unnest(['# Data dictionary: ' || ca.display_name, '`' || ca.urn || '`',
  'Rows (latest profile): ' || COALESCE(format('{:,}', l.row_count), 'not profiled'), '| Column | Type | Description | PII |', '| --- | --- | --- | --- |']) AS line) x
UNION ALL
SELECT asset_id, pos, '| ' || field_path || ' | ' || COALESCE(native_data_type, '') || ' |  | ' ||
 CASE WHEN regexp_matches(field_path, '(?i)""" + PII_RE_SQL + """') THEN 'yes' ELSE 'no' END || ' |'
FROM schema_fields WHERE field_path IS NOT NULL""")

sql("run_steps", """
SELECT run_id, seq, COALESCE(m.label, node) || ' (' || CAST(CAST(round(duration_ms) AS BIGINT) AS VARCHAR) || 'ms)' AS step
FROM run_trace LEFT JOIN (VALUES """ + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in fixed.NODE_LABELS.items()) + """) m(node, label) USING (node)
WHERE status = 'ok'
UNION ALL
SELECT f.run_id, l.last_seq + 1, 'Partial evidence: ' || f.node || ' node failed'
FROM (SELECT run_id, (list(node ORDER BY seq))[1] AS node FROM run_trace WHERE status = 'failed' GROUP BY run_id) f
JOIN (SELECT run_id, max(seq) AS last_seq FROM run_trace GROUP BY run_id) l USING (run_id)""")

sql("findings_json", """
SELECT to_json(struct_pack(asset_id := asset_id, asset_urn := asset_urn, asset_name := asset_name, rule_order := rule_order,
 rule := rule, title := title, severity := severity, points := CAST(points AS BIGINT), detail := detail)) AS json FROM fnd""")


# --- sinks and history --------------------------------------------------------------
sql("aspect_upsert", """
SELECT entity_urn, aspect, item, (list(version ORDER BY version DESC, payload DESC))[1] AS version,
 (list(payload ORDER BY version DESC, payload DESC))[1] AS payload, count(*) AS changes FROM (
 SELECT NULLIF(trim(urn), '') AS entity_urn, 'datasetProperties' AS aspect, '' AS item, COALESCE(CAST(last_modified_ms AS BIGINT), 0) AS version,
  to_json(struct_pack(name := NULLIF(trim(name), ''), description := COALESCE(NULLIF(trim(editable_description), ''), NULLIF(trim(description), '')),
   platform := NULLIF(trim(platform), ''))) AS payload FROM assets WHERE NULLIF(trim(urn), '') IS NOT NULL
 UNION ALL SELECT ca.urn, 'ownership', concat_ws('|', o.owner_urn, o.ownership_type), o.pos, to_json(struct_pack(owner_urn := o.owner_urn, ownership_type := o.ownership_type))
  FROM ownership o JOIN ca USING (asset_id)
 UNION ALL SELECT ca.urn, 'globalTags', t.tag, 0, to_json(struct_pack(tag := t.tag)) FROM asset_tags t JOIN ca USING (asset_id)
 UNION ALL SELECT ca.urn, 'schemaMetadata', s.field_path, s.pos, to_json(struct_pack(field_path := s.field_path, native_data_type := s.native_data_type))
  FROM schema_fields s JOIN ca USING (asset_id)) GROUP BY entity_urn, aspect, item""")

PREV = """
pps AS (SELECT asset_id, count(*) AS n_pii, array_to_string(list(field_path ORDER BY pos, field_path)[1:5], ', ') AS shown
 FROM schema_fields_prev WHERE regexp_matches(field_path, '(?i)""" + PII_RE_SQL + """') GROUP BY asset_id),
prevf AS (
 SELECT f.asset_id, 'missing_owner' AS rule, 'high' AS severity FROM fired f WHERE r_missing_owner
 UNION ALL SELECT asset_id, 'missing_documentation', 'medium' FROM fired WHERE r_missing_documentation
 UNION ALL SELECT f.asset_id, 'untagged_pii', 'critical' FROM fired f JOIN pps USING (asset_id) WHERE pps.n_pii > 0 AND NOT f.pii_tagged
 UNION ALL SELECT asset_id, 'large_downstream_impact', 'high' FROM fired WHERE r_large_downstream_impact
 UNION ALL SELECT asset_id, 'deprecated_in_use', 'high' FROM fired WHERE r_deprecated_in_use
 UNION ALL SELECT asset_id, 'schema_drift', 'medium' FROM fired WHERE r_schema_drift)"""

sql("risk_trend", """
SELECT scan_date, count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high,
 count_if(severity = 'medium') AS medium, count_if(severity = 'low') AS low FROM (
 SELECT 'previous' AS scan_date, severity FROM prevf UNION ALL SELECT 'current', severity FROM fnd) GROUP BY scan_date""", PREV)

sql("finding_diff", """
SELECT COALESCE(p.asset_id, c.asset_id) AS asset_id, COALESCE(p.rule, c.rule) AS rule,
 CASE WHEN p.asset_id IS NULL THEN 'new' WHEN c.asset_id IS NULL THEN 'resolved' ELSE 'persisting' END AS status
FROM prevf p FULL OUTER JOIN fnd c ON p.asset_id = c.asset_id AND p.rule = c.rule""", PREV)

DETAIL = """pd AS (SELECT pc.*, COALESCE(CASE WHEN s_suppkey % 6 = 0 THEN 'team' || s_suppkey || '@example.com' END,
  CASE WHEN s_suppkey % 2 = 0 THEN lower(replace(s_name, '#', '.')) || '@example.com' END) AS email, CASE WHEN s_suppkey % 3 = 1 THEN 'Data steward' END AS title
 FROM pc JOIN supplier ON pc.name = CAST(s_suppkey AS VARCHAR)),
tm AS (SELECT p_partkey AS asset_id, 1 AS pos, 'urn:li:glossaryTerm:' || lower(p_type) AS term_urn,
  CASE WHEN p_partkey % 4 <> 0 THEN p_type ELSE lower(p_type) END AS term, 'Parts of type ' || p_type AS description FROM part
 UNION ALL SELECT p_partkey, 2, 'urn:li:glossaryTerm:personal', 'Personal', NULL FROM part WHERE p_size % 7 = 0 AND p_partkey % 9 <> 0),
lk AS (SELECT p_partkey AS asset_id, 1 AS pos, 'https://wiki.example/' || p_partkey AS url, p_name AS description FROM part WHERE p_partkey % 3 <> 0
 UNION ALL SELECT p_partkey, 2, 'https://runbook.example/', NULL FROM part WHERE p_partkey % 5 = 0),
pr AS (SELECT p_partkey AS asset_id, 'size' AS key, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS value FROM part
 UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE p_partkey % 13 <> 0
 UNION ALL SELECT p_partkey, 'note', '' FROM part WHERE p_partkey % 10 <> 0),
dow AS (SELECT 'urn:li:domain:brand_' || (s_suppkey % 25 + 1) AS domain_urn, CASE WHEN s_suppkey % 50 % 3 = 0 THEN 'urn:li:corpGroup:' ELSE 'urn:li:corpuser:' END || (s_suppkey % 50) AS owner_urn,
  min(s_suppkey) AS pos, arg_min(CASE WHEN s_suppkey % 2 = 0 THEN 'TECHNICAL_OWNER' ELSE 'BUSINESS_OWNER' END, s_suppkey) AS ownership_type FROM supplier GROUP BY 1, 2)"""
_KIND = "CASE WHEN starts_with({0}, 'urn:li:corpuser:') THEN 'USER' ELSE 'GROUP' END"
sql("principal_details", "SELECT owner_urn, " + _KIND.format("owner_urn") + " AS kind, name, display_name, email, title, active FROM pd", DETAIL)
sql("asset_terms", "SELECT asset_id, urn, pos, term_urn, term, tm.description FROM tm JOIN ca USING (asset_id)", DETAIL)
sql("asset_links", "SELECT asset_id, urn, pos, url, lk.description FROM lk JOIN ca USING (asset_id)", DETAIL)
sql("asset_properties", "SELECT asset_id, urn, key, value FROM pr JOIN ca USING (asset_id)", DETAIL)
_STAMP = "strftime(epoch_ms({0}), '%Y-%m-%dT%H:%M:%S')"
sql("asset_deprecations", """SELECT asset_id, urn, assets.deprecated, CASE WHEN asset_id % 2 = 0 THEN 'Use ' || p_brand END AS note,
 CASE WHEN asset_id % 3 = 0 THEN """ + _STAMP.format("1735689600000 + asset_id * 1000") + """ END AS decommission_time
FROM assets JOIN part ON p_partkey = asset_id WHERE assets.deprecated IS NOT NULL""", DETAIL)
sql("schema_detail", """SELECT asset_id, urn, pos, field_path, CASE WHEN pos = 1 THEN 'Identifier' END AS label, CASE WHEN pos = 1 THEN 'NUMBER' ELSE 'STRING' END AS type, native_data_type,
 CASE WHEN pos = 1 THEN FALSE WHEN asset_id % 5 <> 0 THEN TRUE END AS nullable, pos = 1 AS is_part_of_key,
 CASE WHEN pos = 1 AND asset_id % 7 <> 0 THEN 1 END AS key_pos, NULL AS description FROM schema_fields JOIN (SELECT asset_id, urn FROM ca) USING (asset_id)""", DETAIL)
sql("asset_detail", """SELECT asset_id, urn, name, platform, description, deprecated, domain_urn, qualified_name, external_url, sub_types,
 strftime(last_modified, '%Y-%m-%dT%H:%M:%S') AS last_modified, strftime(last_ingested, '%Y-%m-%dT%H:%M:%S') AS last_ingested,
 CASE WHEN asset_id % 12 <> 5 THEN """ + _STAMP.format("1672531200000 + asset_id * 60000") + """ END AS created,
 CASE WHEN deprecated AND asset_id % 2 = 0 THEN 'Use ' || p_brand END AS deprecation_note,
 (SELECT count(*) FROM od WHERE od.asset_id = ca.asset_id) AS n_owners, (SELECT count(*) FROM asset_tags t WHERE t.asset_id = ca.asset_id) AS n_tags,
 (SELECT count(*) FROM tm WHERE tm.asset_id = ca.asset_id) AS n_terms, (SELECT count(*) FROM schema_fields s WHERE s.asset_id = ca.asset_id) AS n_fields,
 CASE WHEN asset_id % 7 <> 0 THEN 1 ELSE 0 END AS n_keys, (SELECT count(*) FROM lk WHERE lk.asset_id = ca.asset_id) AS n_links,
 (SELECT count(*) FROM pr WHERE pr.asset_id = ca.asset_id) AS n_properties, TRUE AS found
FROM ca JOIN part ON p_partkey = asset_id""", DETAIL)
sql("tag_vocabulary", """SELECT COALESCE(v.tag_urn, u.tag_urn) AS tag_urn, COALESCE(v.name, u.tag) AS name, v.description, v.color_hex, CAST(COALESCE(u.n, 0) AS BIGINT) AS asset_count
FROM (SELECT 'urn:li:tag:tier-1' AS tag_urn, 'Tier 1' AS name, 'Most important' AS description, '#ff0000' AS color_hex
 UNION ALL SELECT 'urn:li:tag:PII', NULL, 'Personal data', NULL UNION ALL SELECT 'urn:li:tag:legacy', 'Legacy', NULL, '#cccccc'
 UNION ALL SELECT DISTINCT 'urn:li:tag:' || lower(p_brand), p_brand, NULL, NULL FROM part) v
FULL OUTER JOIN (SELECT 'urn:li:tag:' || tag AS tag_urn, tag, count(DISTINCT asset_id) AS n FROM asset_tags GROUP BY tag) u ON u.tag_urn = v.tag_urn""", DETAIL)
sql("domain_detail", """SELECT dc.domain_urn, CASE dc.domain_urn WHEN 'urn:li:domain:empty' THEN NULL WHEN 'urn:li:domain:unnamed' THEN 'unnamed' ELSE lower(domain_name) END AS id,
 domain_name AS name, CASE WHEN dc.domain_urn NOT IN ('urn:li:domain:empty', 'urn:li:domain:unnamed') THEN 'Parts of ' || domain_name END AS description,
 (SELECT count(*) FROM ca WHERE ca.domain_urn = dc.domain_urn) AS entity_count, (SELECT count(*) FROM dow WHERE dow.domain_urn = dc.domain_urn) AS owner_count FROM dc""", DETAIL)
sql("domain_owners", "SELECT domain_urn, dow.pos, dow.owner_urn, " + _KIND.format("dow.owner_urn") + """ AS kind,
 COALESCE(display_name, split_part(dow.owner_urn, ':', 4)) AS display_name, ownership_type FROM dow LEFT JOIN pc ON pc.owner_urn = dow.owner_urn""", DETAIL)
sql("dataset_owners", "SELECT od.asset_id, urn, od.pos, od.owner_urn, " + _KIND.format("od.owner_urn") + """ AS kind, ownership_type, pd.name, pd.display_name, email, title
FROM od JOIN ca ON ca.asset_id = od.asset_id AND ca.deprecated LEFT JOIN pd ON pd.owner_urn = od.owner_urn""", DETAIL)

def _report() -> str:
    """The lines of the whole report, part by part."""
    from custos.functions import fixed as X

    text = lambda s: "'" + s.replace("'", "''") + "'"
    rows = lambda part, lines, of, at="0": (f"SELECT {part} AS part, 0::BIGINT AS neg_score, {at}::BIGINT AS section_asset, i - 1 AS line_in_section, ls[i] AS line "  # noqa: E731
                                            f"FROM (SELECT *, [{', '.join(lines)}] AS ls FROM {of}) x, generate_series(1, {len(lines)}) g(i)")
    head = [text(X.REPORT_TITLE), "''", text(X.REPORT_LIVE), "''", text(X.REPORT_QUESTION.format(question="Which datasets are highest risk?")), "''", "'| | |'", "'| --- | --- |'",
            "'| Risk level | **' || upper(risk_level) || '** |'", "'| Risk score | ' || score || ' / 100 |'", "'| Findings | ' || total_findings || ' |'",
            "'| Assets with findings | ' || assets_with_findings || ' |'", "'| Intent classified as | `find_risky_datasets` |'", "'| Analysis duration | 1116 ms |'",
            "'| Reasoning provider | rules |'", "'| Generated | 2024-01-01T00:00:00.000Z |'", text(X.REPORT_DEGRADED), "''"]
    told = [text(X.REPORT_SUMMARY_HEADING), "''", "'Governance needs attention.'", "''", text(X.REPORT_IMPACT_HEADING), "''", "'Defects spread downstream.'", "''"]
    one, last = "(SELECT * FROM r WHERE rank = 1)", str(1 << 62)
    note = text(X.REPORT_WORST_NOTE).replace("{score}", "' || score || '")
    return f"""WITH v AS ({ORACLE['catalogue_verdict']}), f AS ({ORACLE['findings']}), r AS ({ORACLE['recommendations']}),
t AS (SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'datasets' WHEN 'view' THEN 'owners' WHEN 'purchase' THEN 'lineage' WHEN 'error' THEN 'statistics' ELSE 'planner' END AS node,
  CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'skipped' ELSE 'failed' END AS status, value FROM events WHERE user_id = (SELECT min(user_id) FROM events)),
s AS (SELECT asset_id, any_value(asset_urn) AS urn, any_value(asset_name) AS name, sum(points)::BIGINT AS raw, least(100, sum(points))::BIGINT AS score,
  list('| `' || rule || '` | ' || severity || ' | ' || points || ' | ' || replace(detail, '|', '\\|') || ' |' ORDER BY rule_order) AS fs,
  string_agg(CAST(points AS VARCHAR), ' + ' ORDER BY rule_order) AS sums FROM f GROUP BY asset_id),
sl AS (SELECT asset_id, score, list_concat(['### ' || name, '', '`' || urn || '`', '', {text(X.REPORT_TABLE_HEAD)}, {text(X.REPORT_TABLE_RULE)}], list_concat(fs, ['| | | **' || score || '** | ' || sums || ' = ' || raw ||
  CASE WHEN raw > score THEN ' (capped at 100)' ELSE '' END || ' → **' || CASE WHEN score >= 70 THEN 'critical' WHEN score >= 40 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END || '** |', ''])) AS ls FROM s)
{rows(0, head, 'v')} UNION ALL {rows(1, told, 'v')}
UNION ALL {rows(2, [text(X.REPORT_FINDINGS_HEADING), "''", text(X.REPORT_FINDINGS_NOTE), "''"], '(SELECT * FROM v WHERE total_findings > 0)')}
UNION ALL SELECT 3, -score, asset_id, i - 1, ls[i] FROM (SELECT *, unnest(generate_series(1, len(ls))) AS i FROM sl)
UNION ALL {rows(4, [note, "''"], '(SELECT * FROM v WHERE assets_with_findings > 1)')}
UNION ALL {rows(5, [text(X.REPORT_RECOMMENDATIONS_HEADING), "''"], one, '-1')}
UNION ALL {rows(5, ["rank || '. **' || action || '** — _' || priority || '_'", "'   ' || rationale"], 'r', 'rank')}
UNION ALL {rows(5, ["''"], one, last)} UNION ALL {rows(6, [text(X.REPORT_NEXT_HEADING), "''"], one, '-1')}
UNION ALL {rows(6, ["'- ' || action"], '(SELECT * FROM r WHERE next_step)', 'rank')} UNION ALL {rows(6, ["''"], one, last)}
UNION ALL {rows(7, [text(X.REPORT_STAGES_HEADING), "''", text(X.REPORT_STAGE_HEAD), text(X.REPORT_STAGE_RULE)], 'v', '-1')}
UNION ALL {rows(7, ["'| ' || node || ' | ' || status || ' | ' || CAST(floor(value + 0.5) AS BIGINT) || ' ms |'"], 't', 'seq')} UNION ALL {rows(7, ["''"], 'v', last)}
UNION ALL {rows(8, [text(X.REPORT_ERRORS_HEADING), "''", "'- lineage timed out'", "''"], 'v')} UNION ALL {rows(9, ["'---'", "''", text(X.REPORT_FOOTER), "''"], 'v')}"""


ORACLE["assessment_report"] = _report()

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# each column's figures by UNPIVOT; what is no number has none
ORACLE["column_profile_merged"] = "\nUNION ALL ".join(
    f"""SELECT '{t}' AS table_name, n.column_name, (SELECT count(*) FROM {t}) AS row_count, (SELECT count(*) FROM {t}) - n.v AS null_count,
 CASE WHEN k.num THEN TRY_CAST(lo.v AS DOUBLE) + 0.0 END AS min, CASE WHEN k.num THEN TRY_CAST(hi.v AS DOUBLE) + 0.0 END AS max, CASE WHEN k.num THEN round(mean.v, 4) + 0.0 END AS mean
FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE v) n
LEFT JOIN (UNPIVOT (SELECT CAST(min(COLUMNS(*)) AS VARCHAR) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE v) lo USING (column_name)
LEFT JOIN (UNPIVOT (SELECT CAST(max(COLUMNS(*)) AS VARCHAR) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE v) hi USING (column_name)
LEFT JOIN (UNPIVOT (SELECT avg(TRY_CAST(CAST(COLUMNS(*) AS VARCHAR) AS DOUBLE)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE v) mean USING (column_name)
JOIN (SELECT column_name, column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') AS num FROM (DESCRIBE {t})) k USING (column_name)""" for t in _TABLES)

sql("risk_incremental", """
SELECT asset_id, urn, display_name AS name, CAST(raw_total AS BIGINT) AS raw_total, CAST(score AS BIGINT) AS score, risk_level, CAST(n_findings AS BIGINT) AS n_findings FROM risk""")

SCANS = """seen AS (SELECT DISTINCT l_partkey AS asset_id, CAST(year(l_shipdate) AS VARCHAR) || '-12-31' AS scan FROM lineitem WHERE l_shipdate IS NOT NULL),
scans AS (SELECT scan, row_number() OVER (ORDER BY scan) AS n, lead(scan) OVER (ORDER BY scan) AS next FROM (SELECT DISTINCT scan FROM seen)),
fld AS (
 SELECT asset_id, 'id' AS field_path, CASE WHEN asset_id % 8 = 0 AND scan < '1998' THEN 'INT' ELSE 'BIGINT' END AS native_data_type, scan FROM assets, scans
 UNION ALL SELECT asset_id, field_path, native_data_type, scan FROM schema_fields JOIN seen USING (asset_id) WHERE pos = 2
 UNION ALL SELECT asset_id, 'legacy_code', 'VARCHAR', scan FROM assets, scans WHERE asset_id % 10 = 0 AND scan < '1997'),
isl AS (SELECT *, n - row_number() OVER (PARTITION BY asset_id, field_path, native_data_type ORDER BY n) AS island FROM fld JOIN scans USING (scan)),
sh AS (SELECT asset_id, field_path, native_data_type, min(scan) AS valid_from, arg_max(next, n) AS last_next, max(n) AS last_n FROM isl
 GROUP BY asset_id, field_path, native_data_type, island),
shist AS (SELECT asset_id, field_path, native_data_type, valid_from,
  CASE WHEN last_n < (SELECT max(n) FROM scans) THEN (SELECT scan FROM scans WHERE n = last_n + 1) END AS valid_to FROM sh)"""
sql("schema_history", "SELECT asset_id, field_path, native_data_type, valid_from, valid_to FROM shist", SCANS)
sql("schema_as_of", """SELECT asset_id, field_path, native_data_type FROM fld
WHERE scan = (SELECT max(scan) FROM scans WHERE scan <= '1997-06-30')""", SCANS)
sql("drift_history", """
SELECT COALESCE(a.asset_id, b.asset_id) AS asset_id, COALESCE(a.field_path, b.field_path) AS field_path, COALESCE(a.scan, b.next) AS at,
 CASE WHEN b.asset_id IS NULL THEN 'added' WHEN a.asset_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
 b.native_data_type AS before, a.native_data_type AS after
FROM (SELECT * FROM fld JOIN scans USING (scan) WHERE n > 1) a
FULL OUTER JOIN (SELECT * FROM fld JOIN scans USING (scan) WHERE next IS NOT NULL) b ON a.asset_id = b.asset_id AND a.field_path = b.field_path AND a.scan = b.next
WHERE a.native_data_type IS DISTINCT FROM b.native_data_type""", SCANS)
sql("risk_trend_history", """
SELECT scan, (SELECT count(*) FROM fld f WHERE f.scan = s.scan AND regexp_matches(field_path, '(?i)""" + PII_RE_SQL + """')
  AND field_path NOT IN ('id', 'legacy_code') AND NOT EXISTS (SELECT 1 FROM ts_ WHERE ts_.asset_id = f.asset_id AND has_pii_tag)) AS critical,
 (SELECT count(*) FROM assets) - (SELECT count(*) FROM seen JOIN assets USING (asset_id) WHERE seen.scan = s.scan) AS high,
 0::BIGINT AS medium, 0::BIGINT AS low FROM scans s""", SCANS)
sql("profile_schema_as_of", """
SELECT p.asset_id, strftime(p.profiled_at, '%Y-%m-%d') AS day, p.row_count, f.native_data_type, f.field_path
FROM profiles p LEFT JOIN fld f ON f.asset_id = p.asset_id AND f.field_path NOT IN ('id', 'legacy_code')
 AND f.scan = (SELECT max(scan) FROM scans WHERE scan <= strftime(p.profiled_at, '%Y-%m-%d'))""", SCANS)

sql("schema_diff", """
SELECT * FROM (
 SELECT COALESCE(p.asset_id, c.asset_id) AS asset_id, COALESCE(p.field_path, c.field_path) AS field_path,
  p.native_data_type AS prev_type, c.native_data_type AS curr_type,
  CASE WHEN p.native_data_type IS NULL AND c.native_data_type IS NOT NULL THEN 'added'
       WHEN c.native_data_type IS NULL AND p.native_data_type IS NOT NULL THEN 'removed'
       WHEN p.native_data_type IS DISTINCT FROM c.native_data_type THEN 'retyped' END AS change
 FROM schema_fields_prev p FULL OUTER JOIN schema_fields c ON p.asset_id = c.asset_id AND p.field_path = c.field_path)
WHERE change IS NOT NULL""")

sql("stale_assets", """
SELECT asset_id, urn, strftime(seen, '%Y-%m-%dT%H:%M:%S') AS last_modified,
 date_diff('day', CAST(seen AS DATE), CAST((SELECT max(COALESCE(last_modified, last_ingested)) FROM ca) AS DATE)) AS days_stale
FROM (SELECT *, COALESCE(last_modified, last_ingested) AS seen FROM ca) WHERE seen IS NOT NULL
 AND date_diff('day', CAST(seen AS DATE), CAST((SELECT max(COALESCE(last_modified, last_ingested)) FROM ca) AS DATE)) > 30""")


# --- remaining inventory keys --------------------------------------------------------
REQ = """
req AS (SELECT COALESCE(ca.urn, 'urn:li:dataset:missing_' || CAST(u.asset_id AS VARCHAR)) AS urn
 FROM (SELECT DISTINCT asset_id FROM usage_events) u LEFT JOIN ca USING (asset_id))"""
sql("dataset_detail", """
SELECT req.urn AS requested_urn, f.urn IS NOT NULL AS found, f.asset_id, f.name, f.display_name, f.platform, f.description,
 f.domain_urn, f.domain_name, CAST(f.owner_count AS BIGINT) AS owner_count, f.owner, CAST(f.tag_count AS BIGINT) AS tag_count,
 f.deprecated, strftime(f.last_modified, '%Y-%m-%dT%H:%M:%S') AS last_modified, strftime(f.last_ingested, '%Y-%m-%dT%H:%M:%S') AS last_ingested,
 f.qualified_name, f.external_url, f.sub_types
FROM (SELECT DISTINCT urn FROM req) req LEFT JOIN facts f ON f.urn = req.urn""", REQ)
sql("dataset_schema", """
SELECT ca.asset_id, ca.urn, s.pos, s.field_path, s.native_data_type
FROM ca LEFT JOIN (SELECT * FROM schema_fields WHERE field_path IS NOT NULL) s USING (asset_id) WHERE ca.urn IN (SELECT urn FROM req)""", REQ)
for _key, _rule_name in [("rule_missing_owner", "missing_owner"),
                         ("rule_missing_documentation", "missing_documentation"),
                         ("rule_untagged_pii", "untagged_pii"),
                         ("rule_large_downstream", "large_downstream_impact"),
                         ("rule_deprecated_in_use", "deprecated_in_use"),
                         ("rule_schema_drift", "schema_drift")]:
    sql(_key, f"""
SELECT asset_id, asset_urn, asset_name, rule_order, rule, title, severity, CAST(points AS BIGINT) AS points, detail
FROM fnd WHERE rule = '{_rule_name}'""")
sql("pii_columns", f"""
SELECT asset_id, pos, field_path FROM schema_fields WHERE regexp_matches(field_path, '(?i){PII_RE_SQL}')""")
sql("pii_tagged_assets", """
SELECT asset_id, urn FROM ca WHERE asset_id IN (SELECT asset_id FROM ts_ WHERE has_pii_tag)""")
sql("score_reconcile", """
SELECT s.asset_id, s.stored_score, CAST(COALESCE(r.recomputed, 0) AS BIGINT) AS recomputed FROM (
 SELECT f.asset_id, CAST(least(100,
   CASE WHEN r_missing_owner THEN 30 ELSE 0 END + CASE WHEN r_missing_documentation THEN 20 ELSE 0 END
   + CASE WHEN COALESCE(pps.n_pii, 0) > 0 AND NOT f.pii_tagged THEN 40 ELSE 0 END
   + CASE WHEN r_large_downstream_impact THEN 20 ELSE 0 END + CASE WHEN r_deprecated_in_use THEN 15 ELSE 0 END
   + CASE WHEN r_schema_drift THEN 15 ELSE 0 END) AS BIGINT) AS stored_score
 FROM fired f LEFT JOIN pps USING (asset_id)) s
LEFT JOIN (SELECT asset_id, least(100, sum(points)) AS recomputed FROM fnd GROUP BY asset_id) r USING (asset_id)
WHERE s.stored_score <> COALESCE(r.recomputed, 0)""", PREV)

sql("raw_documents", """
SELECT urn, name, display_name, platform, description, deprecated, domain_urn,
 strftime(last_modified, '%Y-%m-%dT%H:%M:%S') AS last_modified FROM ca""")
