"""Text outputs: scan summaries (T4), scan briefs (T5), the executive report
(T6), data dictionaries (T7), run steps (T8), the Markdown sink (S9) and JSON
serialisation (S10).

Documents are tables of ``(doc_key, line_no, line)``: every line is computed
where its data lives and a document is only concatenated by the sink, which
writes each document's lines in order. No document - however many findings
a catalogue has - is ever built as one string in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custos.functions import columns as C
from custos.functions import fixed
from custos.operators.assets import clean_assets, schema_clean
from custos.operators.profile import profile_latest


def _fmt_int(c) -> Column:
    """1234 -> '1,234' (en number formatting of a whole number)."""
    return F.format_number(C.col_(c).cast("bigint"), 0)


def _plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


# --- T4: deterministic summary per domain and for the whole scan -----------------------

def scan_summary(scored: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per domain (and one for the catalogue, domain '*'): summary and
    business-impact text with the per-title breakdown in first-seen order.

    Titles are a fixed vocabulary (one per rule), so each breakdown list holds
    at most six entries."""
    dom = F.coalesce("domain_name", F.lit("Unassigned"))
    per_asset = scored.select("asset_id", dom.alias("domain"), "score", "n_findings")
    f = findings.join(per_asset.select("asset_id", "domain"), "asset_id", "inner")

    def titled(frame: DataFrame, keys: list[str]) -> DataFrame:
        t = frame.groupBy(*keys, "title").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("asset_id", "rule_order")).alias("first"))
        return t.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "title", "n"))).alias("t")).select(
            *keys, F.array_join(F.transform("t", lambda x: C.template(fixed.BREAKDOWN_ITEM, title=x["title"], n=x["n"])),
                                "; ").alias("breakdown"))

    # per-domain rows and one catalogue row ('*'), then one equi-join on domain
    both = per_asset.unionByName(per_asset.withColumn("domain", F.lit("*")))
    rows = both.groupBy("domain").agg(
        F.count(F.lit(1)).alias("assets"), F.coalesce(F.max("score"), F.lit(0)).alias("score"),
        F.sum("n_findings").alias("n_findings"))
    f_both = f.unionByName(f.withColumn("domain", F.lit("*")))
    rows = rows.join(titled(f_both, ["domain"]), "domain", "left")
    level = C.risk_level("score")
    none = F.coalesce(F.col("n_findings"), F.lit(0)) == 0
    summary = F.when(none, C.template(fixed.SUMMARY_CLEAN, assets=F.col("assets"), level=level,
                                      score=F.col("score"))).otherwise(
        C.template(fixed.SUMMARY_FINDINGS, assets=F.col("assets"), findings=F.col("n_findings"),
                   breakdown=F.col("breakdown"), level=level, score=F.col("score")))
    impact = F.when(none, F.lit(fixed.IMPACT_CLEAN)).otherwise(F.lit(fixed.IMPACT_FINDINGS))
    return rows.select("domain", F.col("assets").cast("bigint").alias("assets"),
                       F.col("score").cast("bigint").alias("score"), level.alias("risk_level"),
                       F.coalesce("n_findings", F.lit(0)).cast("bigint").alias("findings"),
                       summary.alias("summary"), impact.alias("business_impact"))


# --- T5: scan brief per domain ---------------------------------------------------------

def domain_metrics(gov: DataFrame, owners_per_domain: DataFrame) -> DataFrame:
    """A9 grouped by domain (score, totals, critical, missing owners, doc %)."""
    n = F.count(F.lit(1))
    m = gov.groupBy("domain").agg(
        F.floor((F.sum("health") * 2 + n) / (n * 2)).cast("bigint").alias("score"),
        n.alias("total_assets"),
        F.count_if(F.col("health") >= 80).alias("healthy_assets"),
        F.count_if(F.col("severity") == "critical").alias("critical_issues"),
        F.count_if(F.col("owner").isNull()).alias("missing_owners"),
        C.pct(F.count_if(F.col("description").isNotNull()), n).alias("documentation_coverage"))
    return m.join(owners_per_domain, "domain", "left").select(
        "*", F.coalesce("owners", F.lit(0)).alias("owner_count")).drop("owners")


def scan_brief(gov: DataFrame, owners_per_domain: DataFrame, domain_count: Column) -> DataFrame:
    """Headline, four labelled findings with tone and up to four actions per
    domain, as rows (domain, kind, ord, text, detail, tone)."""
    m = domain_metrics(gov, owners_per_domain)
    crit, miss, doc, score = (F.col("critical_issues"), F.col("missing_owners"),
                              F.col("documentation_coverage"), F.col("score"))
    total = F.col("total_assets")
    assets = F.concat(_fmt_int(total), F.lit(" "), _plural(total, "asset", "assets"))
    headline = (F.when(crit > 0, C.template(fixed.BRIEF_HEADLINE_CRITICAL, assets=assets, critical=crit))
                .when(miss > 0, C.template(fixed.BRIEF_HEADLINE_UNOWNED, assets=assets, missing=miss,
                                           have=_plural(miss, "asset has", "assets have")))
                .when(doc < 80, C.template(fixed.BRIEF_HEADLINE_DOCS, assets=assets, doc=doc))
                .otherwise(C.template(fixed.BRIEF_HEADLINE_CLEAN, assets=assets, score=score)))
    dc = domain_count
    none = F.lit(None).cast("string")
    items = [
        (F.lit("headline"), F.lit(0), headline, none, none),
        (F.lit("finding"), F.lit(1),
         C.template(fixed.BRIEF_CRITICAL_LABEL, critical=crit, risks=_plural(crit, "risk", "risks")),
         F.when(crit > 0, F.lit(fixed.BRIEF_CRITICAL_DETAIL)).otherwise(F.lit(fixed.BRIEF_CRITICAL_NONE)),
         F.when(crit > 0, F.lit("critical")).otherwise(F.lit("positive"))),
        (F.lit("finding"), F.lit(2), C.template(fixed.BRIEF_OWNER_LABEL, missing=miss),
         F.when(miss > 0, F.lit(fixed.BRIEF_OWNER_DETAIL)).otherwise(
             C.template(fixed.BRIEF_OWNER_ALL, owners=F.col("owner_count"))),
         F.when(miss > 0, F.lit("warning")).otherwise(F.lit("positive"))),
        (F.lit("finding"), F.lit(3), C.template(fixed.BRIEF_DOC_LABEL, doc=doc),
         C.template(fixed.BRIEF_DOC_DETAIL, domains=dc, domain_word=_plural(dc, "domain", "domains")),
         F.when(doc >= 80, F.lit("positive")).otherwise(F.lit("warning"))),
        (F.lit("finding"), F.lit(4), C.template(fixed.BRIEF_HEALTH_LABEL, score=score),
         C.template(fixed.BRIEF_HEALTH_DETAIL, healthy=F.col("healthy_assets")),
         F.when(score >= 80, F.lit("positive")).when(score >= 50, F.lit("warning")).otherwise(F.lit("critical"))),
    ]
    acts = fixed.BRIEF_ACTIONS
    actions = [
        (crit > 0, F.lit(acts[0][0]), F.lit(acts[0][1])),
        (miss > 0, F.concat(F.lit("Review "), miss.cast("string"), F.lit(" unowned "), _plural(miss, "asset", "assets")),
         F.lit(acts[1][1])),
        (F.lit(True), F.lit(acts[2][0]), F.lit(acts[2][1])),
        (F.lit(True), F.lit(acts[3][0]), F.lit(acts[3][1])),
    ]
    act_arr = F.filter(F.array(*[F.struct(on.alias("on"), lbl.alias("label"), prompt.alias("prompt"))
                                 for on, lbl, prompt in actions]), lambda a: a["on"])
    act_rows = F.transform(F.slice(act_arr, 1, 4), lambda a, i: F.struct(
        F.lit("action").alias("kind"), (i + 1).alias("ord"), a["label"].alias("text"),
        a["prompt"].alias("detail"), F.lit(None).cast("string").alias("tone")))
    fixed_rows = F.array(*[F.struct(k.alias("kind"), o.alias("ord"), t.alias("text"), d.alias("detail"),
                                    tn.alias("tone")) for k, o, t, d, tn in items])
    return m.select("domain", F.explode(F.concat(fixed_rows, act_rows)).alias("x")).select(
        "domain", "x.kind", "x.ord", "x.text", "x.detail", "x.tone")


# --- T6: executive report --------------------------------------------------------------

def _esc_pipes(c) -> Column:
    return F.regexp_replace(C.col_(c), r"\|", r"\\|")


def executive_report(verdict: DataFrame, findings: DataFrame, recs: DataFrame, question: str,
                     intent: str, source: str = "live") -> DataFrame:
    """The Markdown assessment as (section, line_no, line) rows.

    Section 0 is the header and verdict table; each asset with findings is
    its own section (sections sort by score, worst first, then scan order);
    the recommendations and footer close the document. Within a section the
    line number orders the lines."""
    hdr = verdict.select(F.posexplode(F.array(*[
        F.lit(fixed.REPORT_TITLE), F.lit(""),
        F.lit(fixed.REPORT_DEMO if source == "demo" else fixed.REPORT_LIVE),
        F.lit(""), F.lit(fixed.REPORT_QUESTION.format(question=question)), F.lit(""), F.lit("| | |"), F.lit("| --- | --- |"),
        F.concat(F.lit("| Risk level | **"), F.upper("risk_level"), F.lit("** |")),
        F.concat(F.lit("| Risk score | "), F.col("score").cast("string"), F.lit(" / 100 |")),
        F.concat(F.lit("| Findings | "), F.col("total_findings").cast("string"), F.lit(" |")),
        F.concat(F.lit("| Assets with findings | "), F.col("assets_with_findings").cast("string"), F.lit(" |")),
        F.lit(f"| Intent classified as | `{intent}` |"), F.lit(""),
        F.lit(fixed.REPORT_FINDINGS_HEADING), F.lit(""), F.lit(fixed.REPORT_FINDINGS_NOTE),
        F.lit("")])).alias("_i", "line"))
    hdr = hdr.select(F.lit(0).cast("bigint").alias("section_score"), F.lit(0).cast("bigint").alias("section_asset"),
                     "_i", "line")

    # per-asset sections: bounded (one row per triggered rule, at most six)
    per = findings.groupBy("asset_id", "asset_urn", "asset_name").agg(
        F.array_sort(F.collect_list(F.struct("rule_order", "rule", "severity", "points", "detail"))).alias("fs"),
        F.sum("points").alias("raw"))
    per = per.select("*", F.least(F.lit(fixed.SCORE_CAP), "raw").alias("score"))
    rows = F.transform("fs", lambda f: F.concat(F.lit("| `"), f["rule"], F.lit("` | "), f["severity"], F.lit(" | "),
                                                 f["points"].cast("string"), F.lit(" | "), _esc_pipes(f["detail"]), F.lit(" |")))
    total_line = F.concat(
        F.lit("| | | **"), F.col("score").cast("string"), F.lit("** | "),
        F.array_join(F.transform("fs", lambda f: f["points"].cast("string")), " + "), F.lit(" = "),
        F.col("raw").cast("string"), F.when(F.col("raw") > F.col("score"), F.lit(" (capped at 100)")).otherwise(F.lit("")),
        F.lit(" → **"), C.risk_level("score"), F.lit("** |"))
    lines = F.concat(
        F.array(F.concat(F.lit("### "), F.coalesce("asset_name", F.lit("Catalogue-wide"))), F.lit("")),
        F.when(F.col("asset_urn").isNotNull(), F.array(F.concat(F.lit("`"), "asset_urn", F.lit("`")), F.lit("")))
         .otherwise(F.array().cast("array<string>")),
        F.array(F.lit(fixed.REPORT_TABLE_HEAD), F.lit(fixed.REPORT_TABLE_RULE)),
        rows, F.array(total_line, F.lit("")))
    sections = per.select(F.col("score").cast("bigint").alias("section_score"),
                          F.col("asset_id").cast("bigint").alias("section_asset"),
                          F.posexplode(lines).alias("_i", "line"))
    tail_lines = recs.select(F.posexplode(F.array(
        F.concat(F.col("rank").cast("string"), F.lit(". **"), F.col("action"), F.lit("** — _"), F.col("priority"), F.lit("_")),
        F.concat(F.lit("   "), F.col("rationale")))).alias("_i", "line"), "rank")
    recs_lines = tail_lines.select(F.lit(-1).cast("bigint").alias("section_score"), F.col("rank").cast("bigint").alias("section_asset"),
                                   "_i", "line")
    doc = hdr.unionByName(sections).unionByName(recs_lines)
    # order: header (0), asset sections by score desc / asset id, recommendations
    return doc.select(
        F.when(F.col("section_score") == 0, F.lit(0)).when(F.col("section_score") > 0, F.lit(1)).otherwise(F.lit(2)).alias("part"),
        (-F.col("section_score")).alias("neg_score"), "section_asset", F.col("_i").alias("line_in_section"), "line")


@dataclass(frozen=True)
class Run:
    """What an assessment says about its own run."""

    question: str
    intent: str
    generated: str  # ISO time; explicit, as jobs read no clock
    duration_ms: float
    provider: str | None = None
    degraded: bool = False
    summary: str | None = None
    impact: str | None = None
    errors: tuple[str, ...] = ()
    source: str = "live"


def assessment_report(verdict: DataFrame, findings: DataFrame, recs: DataFrame, trace: DataFrame, run: Run) -> DataFrame:
    """T6 with all its parts, as (part, neg_score, section_asset, line_in_section, line) rows in the order of these columns.

    Part 0 is the header with the table of the run, 1 summary and business impact, 2 the heading of the findings, 3 a section for each asset
    (worst first), 4 the note on several assets, 5 recommendations, 6 next steps, 7 the stages (``trace``: seq, node, status,
    duration_ms), 8 errors, 9 the footer. Parts without content have no rows."""
    def fixed_part(part: int, lines: list, of: DataFrame = verdict) -> DataFrame:
        rows = F.array(*[x if isinstance(x, Column) else F.lit(x) for x in lines])
        return of.select(F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("neg_score"), F.lit(0).cast("bigint").alias("section_asset"),
                         F.posexplode(rows).alias("line_in_section", "line"))

    row = lambda label, value: C.template("| {label} | {value} |", label=F.lit(label), value=value)
    whole = lambda ms: F.floor(ms + 0.5).cast("bigint").cast("string")
    head = [fixed.REPORT_TITLE, "", fixed.REPORT_DEMO if run.source == "demo" else fixed.REPORT_LIVE, "", fixed.REPORT_QUESTION.format(question=run.question), "",
            "| | |", "| --- | --- |", row("Risk level", F.concat(F.lit("**"), F.upper("risk_level"), F.lit("**"))),
            row("Risk score", F.concat(F.col("score").cast("string"), F.lit(" / 100"))), row("Findings", F.col("total_findings").cast("string")),
            row("Assets with findings", F.col("assets_with_findings").cast("string")), f"| Intent classified as | `{run.intent}` |",
            row("Analysis duration", F.concat(whole(F.lit(run.duration_ms)), F.lit(" ms"))), *([f"| Reasoning provider | {run.provider} |"] if run.provider else []),
            f"| Generated | {run.generated} |", *([fixed.REPORT_DEGRADED] if run.degraded else []), ""]
    told = [*([fixed.REPORT_SUMMARY_HEADING, "", run.summary, ""] if run.summary else []), *([fixed.REPORT_IMPACT_HEADING, "", run.impact, ""] if run.impact else [])]
    sections = executive_report(verdict, findings, recs, run.question, run.intent, run.source).where("part = 1").select(
        F.lit(3).alias("part"), "neg_score", "section_asset", "line_in_section", "line")
    listed = lambda part, df, lines: df.select(F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("neg_score"),
                                               F.col("at").cast("bigint").alias("section_asset"), F.posexplode(lines).alias("line_in_section", "line"))
    some = recs.where("rank = 1")  # a heading needs its list, a line needs an end
    rec = F.concat(F.array(F.concat(F.col("rank").cast("string"), F.lit(". **"), F.col("action"), F.lit("** — _"), F.col("priority"), F.lit("_"))),
                   F.when(F.coalesce("rationale", F.lit("")) != "", F.array(F.concat(F.lit("   "), F.col("rationale")))).otherwise(F.array().cast("array<string>")))
    stage = F.concat(F.lit("| "), F.col("node"), F.lit(" | "), F.col("status"), F.lit(" | "), whole(F.col("duration_ms")), F.lit(" ms |"))
    last = (1 << 62)  # after every list
    end = lambda part, of: listed(part, of.withColumn("at", F.lit(last)), F.array(F.lit("")))
    heading = lambda part, lines, of: listed(part, of.withColumn("at", F.lit(-1)), F.array(*map(F.lit, lines)))
    step = recs.where("next_step")
    parts = [
        fixed_part(0, head), *([fixed_part(1, told)] if told else []),
        fixed_part(2, [fixed.REPORT_FINDINGS_HEADING, "", fixed.REPORT_FINDINGS_NOTE, ""], verdict.where("total_findings > 0")), sections,
        fixed_part(4, [C.template(fixed.REPORT_WORST_NOTE, score=F.col("score").cast("string")), ""], verdict.where("assets_with_findings > 1")),
        heading(5, [fixed.REPORT_RECOMMENDATIONS_HEADING, ""], some), listed(5, recs.withColumn("at", F.col("rank")), rec), end(5, some),
        heading(6, [fixed.REPORT_NEXT_HEADING, ""], some), listed(6, step.withColumn("at", F.col("rank")), F.array(F.concat(F.lit("- "), F.col("action")))), end(6, some),
        heading(7, [fixed.REPORT_STAGES_HEADING, "", fixed.REPORT_STAGE_HEAD, fixed.REPORT_STAGE_RULE], verdict),
        listed(7, trace.withColumn("at", F.col("seq")), F.array(stage)), end(7, verdict),
        *([fixed_part(8, [fixed.REPORT_ERRORS_HEADING, "", *[f"- {e}" for e in run.errors], ""])] if run.errors else []),
        fixed_part(9, ["---", "", fixed.REPORT_FOOTER, ""])]
    return reduce(DataFrame.unionByName, parts)


# --- T7: data dictionary ------------------------------------------------------------------

def data_dictionary(cat) -> DataFrame:
    """Per dataset: a Markdown table (Column, Type, Description, PII) plus the
    latest profile facts, as ordered lines (asset_id, line_no, line)."""
    a = clean_assets(cat).select("asset_id", "display_name", "urn", "description")
    latest = profile_latest(cat)
    texts = [F.concat(F.lit("# Data dictionary: "), "display_name"),
             F.concat(F.lit("`"), "urn", F.lit("`")),
             F.concat(F.lit("Rows (latest profile): "), F.coalesce(_fmt_int("row_count"), F.lit("not profiled"))),
             F.lit("| Column | Type | Description | PII |"),
             F.lit("| --- | --- | --- | --- |")]
    head = a.join(latest, "asset_id", "left").select(
        "asset_id", F.explode(F.array(*[
            F.struct(F.lit(i - 4).alias("line_no"), t.alias("line")) for i, t in enumerate(texts)])).alias("x")).select(
        "asset_id", F.col("x.line_no").alias("line_no"), F.col("x.line").alias("line"))
    fields = schema_clean(cat).select(
        "asset_id", F.col("pos").cast("int").alias("line_no"),
        F.concat(F.lit("| "), _esc_pipes("field_path"), F.lit(" | "), F.coalesce(_esc_pipes("native_data_type"), F.lit("")),
                 F.lit(" | "), F.coalesce(_esc_pipes("field_description"), F.lit("")), F.lit(" | "),
                 F.when(C.looks_like_pii("field_path"), F.lit("yes")).otherwise(F.lit("no")), F.lit(" |")).alias("line"))
    return head.unionByName(fields)


# --- T8: run steps ------------------------------------------------------------------------------

def run_steps(run_trace: DataFrame) -> DataFrame:
    """Per run: one step per ok node, '<label> (<ms>ms)', in trace order, plus
    'Partial evidence: ...' after the steps when the run is degraded."""
    labels = F.create_map(*[x for k, v in fixed.NODE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    ok = run_trace.where(F.col("status") == "ok").select(
        "run_id", "seq", C.template(fixed.RUN_STEP, label=F.coalesce(F.element_at(labels, F.col("node")), F.col("node")),
                                    ms=F.round("duration_ms", 0).cast("bigint")).alias("step"))
    failed = run_trace.where(F.col("status") == "failed").groupBy("run_id").agg(
        F.min(F.struct("seq", "node")).alias("f"))
    last = run_trace.groupBy("run_id").agg(F.max("seq").alias("last_seq"))
    partial = failed.join(last, "run_id", "inner").select(
        "run_id", (F.col("last_seq") + 1).alias("seq"),
        C.template(fixed.RUN_PARTIAL, node=F.col("f.node")).alias("step"))
    return ok.unionByName(partial)


# --- S9: Markdown sink ------------------------------------------------------------------------

def safe_name(*parts: Column) -> Column:
    """File-name-safe slug: runs of characters other than letters/digits -> '-'."""
    return F.regexp_replace(F.concat_ws("-", *parts), "[^A-Za-z0-9]+", "-")


def write_documents(lines: DataFrame, path: str, doc_key: str, order: list[str], line_col: str = "line") -> None:
    """Write each document's lines, in order, as numbered text files in one folder per
    document (``<path>/<doc_key>=<value>/part-*.txt``); its files in the order of their names are
    the document. Lines are range partitioned by document and place, so a large document is
    split over tasks, and sorted inside each partition."""
    (lines.repartitionByRange(doc_key, *order).sortWithinPartitions(doc_key, *order)
     .select(doc_key, line_col).write.mode("overwrite").partitionBy(doc_key).text(path))


def report_filename(intent: str, as_of: str, prefix: str = "governance") -> str:
    """`<prefix>-<intent>-<YYYY-MM-DD-HH-MM-SS>.md` from an ISO timestamp."""
    stamp = as_of[:19].replace(":", "-").replace("T", "-")
    return f"{prefix}-{intent}-{stamp}.md"


# --- S10: JSON-safe serialisation ------------------------------------------------------------

def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row; timestamps as ISO-8601, enums already strings,
    nested structs / arrays / maps serialised recursively."""
    return df.select(C.json_of(*df.columns).alias("json"))
