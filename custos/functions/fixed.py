"""Fixed values.

FIXED VALUES: everything in this module must stay equal to the behaviour being
reproduced (rule book, bands, patterns, word lists, fixed sentences). They are
stated plainly, in their natural order, and are data - the Spark jobs read
them as literals or as tiny broadcast tables.
"""

from __future__ import annotations

# --- Rule book: key, title, points, severity, in evaluation order -------------
RULES = [
    ("missing_owner", "No owner assigned", 30, "high"),
    ("missing_documentation", "No description or documentation", 20, "medium"),
    ("untagged_pii", "Probable PII without a classification tag", 40, "critical"),
    ("large_downstream_impact", "Large downstream blast radius", 20, "high"),
    ("deprecated_in_use", "Deprecated but still consumed", 15, "high"),
    ("schema_drift", "Schema drift since last scan", 15, "medium"),
]

# Per-asset detail sentences (placeholders filled by the scoring job).
DETAIL_MISSING_OWNER = ("No owner is assigned, so there is no accountable responder "
                        "when this asset breaks.")
DETAIL_MISSING_DOCUMENTATION = ("No description, so consumers cannot tell what this asset "
                                "means or whether it fits their use case.")
DETAIL_UNTAGGED_PII = ("Columns match personal-data patterns but carry no classification "
                       "tag: {shown}{more}.")
DETAIL_PII_MORE = " (+{n} more)"
DETAIL_LARGE_DOWNSTREAM = "{n} downstream assets consume this, so any defect propagates widely."
DETAIL_DEPRECATED_IN_USE = ("Marked deprecated but still read by {n} asset(s), risking "
                            "silently stale data.")
DETAIL_SCHEMA_DRIFT = ("Schema changed since the previous scan; downstream models may not "
                       "have been updated.")

DOWNSTREAM_THRESHOLD = 5
SCORE_CAP = 100
PII_SHOWN = 5

# Risk bands on the score: (minimum, level), first match wins, else low.
RISK_BANDS = [(70, "critical"), (40, "high"), (20, "medium")]
# Health bands on the governance row: (upper bound exclusive, severity), else low.
HEALTH_BANDS = [(40, "critical"), (60, "high"), (80, "medium")]
SEVERITY_LEVELS = ["critical", "high", "medium", "low"]

# --- Personal-data column names: alternatives anchored on start/end or "_" ---
PII_ALTERNATIVES = [
    "email", "phone", "mobile", "address", "postcode", "zip_?code",
    "ssn", "sin", "nin", "passport", "tax_?id", "national_?id",
    "credit_?card", "card_?number", "iban", "account_?number",
    "first_?name", "last_?name", "full_?name", "sur_?name", "maiden_?name",
    "dob", "birth_?date", "date_of_birth", "birth_?day",
]
PII_PATTERN = "(?i)(?:^|_)(?:" + "|".join(PII_ALTERNATIVES) + ")(?:_|$)"

# Tag-name fragments that count as a sensitivity classification.
PII_TAG_HINTS = ["pii", "sensitive", "personal", "gdpr", "confidential", "phi"]

# --- Corrective action per rule: (action, rationale) -------------------------
FALLBACK_ACTIONS = {
    "missing_owner": ("Assign an accountable owner",
                      "Ownership is the prerequisite for every other governance control."),
    "missing_documentation": ("Generate and review a description",
                              "Consumers cannot assess fitness for use without one."),
    "untagged_pii": ("Apply a PII classification tag",
                     "Untagged personal data is a compliance exposure and blocks access control."),
    "large_downstream_impact": ("Add a freshness SLA and on-call ownership",
                                "Blast radius this size means failures reach production consumers."),
    "deprecated_in_use": ("Migrate remaining consumers and set a decommission date",
                          "Deprecated assets still in use silently serve stale data."),
    "schema_drift": ("Reconcile downstream models with the new schema",
                     "Drift breaks consumers quietly, often without an error."),
}
MAX_RECOMMENDATIONS = 5
MAX_NEXT_STEPS = 3
TOP_FINDINGS = 8
TOP_RISK_ASSETS = 6

# --- Rule policy text: rationale, metadata used, consequence ------------------
RULE_DOCS = {
    "untagged_pii": (
        "The heaviest weight in the rule book, because it is the only rule with a regulatory "
        "consequence rather than a productivity cost. Column names are matched against "
        "personal-data patterns, anchored on word boundaries so `emailer_job_id` is not flagged.",
        "Schema field names · classification tags",
        "Personal data is processed without a classification, so it is invisible to retention, "
        "access-control, and subject-access workflows."),
    "missing_owner": (
        "Weighted second because ownership is the precondition for every other fix. An unowned "
        "asset has no one to assign the remaining findings to.",
        "Ownership aspect (users and groups)",
        "No accountable responder when this asset breaks, so incidents route to whoever "
        "notices first."),
    "missing_documentation": (
        "A productivity cost rather than a compliance one, so it is weighted below ownership and "
        "PII. It compounds: every consumer re-derives the same knowledge independently.",
        "Dataset description · editable properties",
        "Consumers cannot tell what the asset means or whether it fits their use case, so they "
        "guess."),
    "large_downstream_impact": (
        "Not a defect on its own — it is a multiplier. Blast radius is what separates a backlog "
        "ticket from a priority, and it is the reason lineage matters to governance at all. "
        "Fires at five or more downstream consumers.",
        "Downstream lineage graph",
        "Any defect in this asset propagates to everything built on top of it."),
    "deprecated_in_use": (
        "Fires only when an asset is both deprecated AND still consumed. A deprecated asset with "
        "no consumers is a tidy retirement, not a finding.",
        "Deprecation aspect · downstream lineage",
        "Consumers are reading an asset nobody maintains, so they may be serving silently stale "
        "numbers."),
    "schema_drift": (
        "Fires only on an explicit upstream signal. Full drift detection needs a stored snapshot "
        "of the previous schema, which arrives with scan history — until then the rule never "
        "guesses, because a fabricated drift finding is worse than a missed one.",
        "Schema metadata · upstream drift signal",
        "The schema changed and downstream models may not have been updated to match."),
}
GENERIC_RULE_DOC = (
    "A deterministic governance rule. Its weight and severity are defined in the backend rule "
    "book.",
    "Catalogue metadata",
    "See the finding detail for the specific consequence.")

# --- Question intents: (intent, keywords, excludes, weight), in rule order ----
INTENT_RULES = [
    ("generate_report",
     ["report", "executive summary", "daily summary", "weekly summary", "briefing"], [], 3),
    ("generate_documentation",
     ["documentation", "document", "readme", "data dictionary", "describe"], ["report"], 3),
    ("find_missing_owners",
     ["without owner", "no owner", "missing owner", "unowned", "who owns", "ownership"], [], 3),
    ("analyze_lineage",
     ["lineage", "downstream", "upstream", "impact", "blast radius", "depends on"], [], 2),
    ("find_risky_datasets",
     ["risk", "risky", "dangerous", "critical", "vulnerable", "exposure", "pii"], [], 2),
    ("analyze_governance",
     ["governance", "health", "compliance", "quality", "coverage", "analyze", "audit"], [], 1),
]

# Node plan per intent (graph order) and the intents that end in a recommendation.
INTENT_NODES = {
    "find_missing_owners": ["datasets", "owners", "risk", "reasoning"],
    "analyze_governance": ["datasets", "owners", "statistics", "risk", "reasoning"],
    "analyze_lineage": ["datasets", "lineage", "risk", "reasoning"],
    "find_risky_datasets": ["datasets", "owners", "lineage", "risk", "reasoning"],
    "generate_documentation": ["datasets", "statistics", "reasoning"],
    "generate_report": ["datasets", "owners", "statistics", "risk", "reasoning", "report"],
    "unknown": ["datasets", "reasoning"],
}
RECOMMEND_FOR = ["find_missing_owners", "analyze_governance", "find_risky_datasets",
                 "analyze_lineage"]

# A catalogue URN quoted in a question, and a bare dotted / snake_case name.
URN_PATTERN = r"urn:li:[a-zA-Z]+:\([^)]*\)|urn:li:[a-zA-Z]+:[\w.\-]+"
NAME_PATTERN = r"\b([a-z][a-z0-9_]{2,}(?:\.[a-z0-9_]+){0,3})\b"
NAME_STOPWORDS = [
    "datasets", "dataset", "owners", "owner", "lineage", "governance", "documentation",
    "report", "risk", "risky", "without", "missing", "analyze", "analyse", "explain",
    "generate", "which", "what", "show", "find", "assets", "asset", "metadata",
    "downstream", "upstream", "impact", "summary", "health", "quality", "compliance",
    "coverage", "critical", "highest", "table", "tables", "have", "that", "with", "the",
    "and", "for", "are", "all", "any", "pii", "tags", "tag",
]

# --- Run trace presentation ------------------------------------------------------
NODE_LABELS = {
    "planner": "Classified the question and selected which tools to run",
    "datasets": "Retrieved dataset metadata from the catalogue",
    "owners": "Resolved ownership records",
    "lineage": "Traced upstream and downstream lineage",
    "statistics": "Collected profiling and usage statistics",
    "risk": "Applied deterministic governance rules",
    "reasoning": "Explained the findings",
    "recommendation": "Derived corrective actions",
    "report": "Formatted the governance report",
}

# Evidence sources: (node, label, purpose), in display order.
EVIDENCE_SOURCES = [
    ("datasets", "Schema & tags", "Column names and classifications — the basis for PII detection"),
    ("owners", "Ownership", "Who is accountable for each asset"),
    ("lineage", "Lineage", "Downstream blast radius, which sets priority"),
    ("statistics", "Usage & profiling", "Row counts and query activity"),
]

# --- Asset kind by platform ------------------------------------------------------
PIPELINE_PLATFORMS = ["dbt", "airflow", "spark", "kafka"]
DASHBOARD_PLATFORMS = ["looker", "tableau", "powerbi", "superset"]

# --- Scan brief (per domain) -----------------------------------------------------
BRIEF_ACTIONS = [
    ("Investigate critical risks", "Which datasets are highest risk?"),
    ("Review {n} unowned {noun}", "Find datasets without owners"),
    ("Scan for untagged PII", "Find untagged PII across all datasets"),
    ("Generate executive report", "Create a governance report"),
]

# Usage time ranges in days.
TIME_RANGE_DAYS = {"DAY": 1, "WEEK": 7, "MONTH": 30, "QUARTER": 90, "YEAR": 365}

# --- Fixed sentences of the text outputs ({name} marks a value filled per row) --
SUMMARY_CLEAN = "Examined {assets} asset(s) and found no rule violations. Risk level {level} (score {score})."
SUMMARY_FINDINGS = ("Examined {assets} asset(s) and found {findings} rule violation(s): {breakdown}. "
                    "Risk level {level} (score {score}). AI explanation was unavailable, so this summary "
                    "is generated directly from the rule engine.")
IMPACT_CLEAN = "No governance issues were detected in this scan."
IMPACT_FINDINGS = ("Findings are listed below with the rule each one triggered. Review them directly — "
                   "the narrative explanation could not be generated.")
BREAKDOWN_ITEM = "{title} ({n})"

BRIEF_HEADLINE_CRITICAL = ("I analysed {assets} and found {critical} at critical risk. Ownership and "
                           "classification gaps are the largest contributors.")
BRIEF_HEADLINE_UNOWNED = "I analysed {assets}. Nothing is at critical risk, but {missing} {have} no accountable owner."
BRIEF_HEADLINE_DOCS = ("I analysed {assets}. Ownership is complete; documentation coverage is {doc}% and is "
                       "now the weakest signal.")
BRIEF_HEADLINE_CLEAN = "I analysed {assets} and found no critical governance gaps. Metadata health is {score}/100."
BRIEF_CRITICAL_LABEL = "{critical} critical {risks}"
BRIEF_CRITICAL_DETAIL = "Assets with health below 40 on the governance score"
BRIEF_CRITICAL_NONE = "No asset has health below 40"
BRIEF_OWNER_LABEL = "{missing} without an owner"
BRIEF_OWNER_DETAIL = "No accountable responder when these break"
BRIEF_OWNER_ALL = "All assets have an owner across {owners} people and groups"
BRIEF_DOC_LABEL = "{doc}% documented"
BRIEF_DOC_DETAIL = "Assets carrying a description · {domains} business {domain_word}"
BRIEF_HEALTH_LABEL = "{score}/100 metadata health"
BRIEF_HEALTH_DETAIL = "Composite of ownership, documentation, and classification · {healthy} assets above 80"

NODE_DEPRECATED_TEXT = "Marked deprecated but still present in this lineage path."
NODE_HOP_TEXT = "{entity_type} at hop {degree} from the traced asset."
ROOT_NODE_TEXT = "The asset this lineage was traced from."

RUN_STEP = "{label} ({ms}ms)"
RUN_PARTIAL = "Partial evidence: {node} node failed"

EVIDENCE_OWNED = "owned by {owner}"
EVIDENCE_NO_OWNER = "no owner"
EVIDENCE_UNDOCUMENTED = "undocumented"
EVIDENCE_DOWNSTREAM = "{n} downstream"
EVIDENCE_NOTHING = "no issues found"
ALERT_DETAIL = "{asset} · {n} downstream"

REPORT_TITLE = "# Governance Assessment"
REPORT_DEMO = ("> **Demo data.** This report was generated from the built-in demonstration catalogue, "
               "not from a live catalogue instance.")
REPORT_LIVE = "> Generated from live catalogue metadata."
REPORT_QUESTION = "**Question:** {question}"
REPORT_FINDINGS_HEADING = "## Findings"
REPORT_FINDINGS_NOTE = ("Scores are produced by a deterministic rule engine, not by a language model. Each "
                        "rule contributes a fixed weight, so the arithmetic below can be checked by hand.")
REPORT_TABLE_HEAD = "| Rule | Severity | Points | Detail |"
REPORT_TABLE_RULE = "| --- | --- | ---: | --- |"
REPORT_SUMMARY_HEADING = "## Executive summary"
REPORT_IMPACT_HEADING = "## Business impact"
REPORT_WORST_NOTE = "> The catalogue score (**{score}**) is the worst asset's score, not the sum across assets."
REPORT_RECOMMENDATIONS_HEADING = "## Recommendations"
REPORT_NEXT_HEADING = "## Next steps"
REPORT_STAGES_HEADING = "## How this was produced"
REPORT_STAGE_HEAD = "| Stage | Status | Duration |"
REPORT_STAGE_RULE = "| --- | --- | ---: |"
REPORT_DEGRADED = "| Status | **Degraded — partial evidence** |"
REPORT_ERRORS_HEADING = "### Errors encountered"
REPORT_FOOTER = ("_Risk scores are deterministic and reproducible; narrative sections are model-generated from the evidence above._")
