"""The whole assessment: which parts it has, and their lines in order."""

from custos.operators import reports as T
from custos.operators import rollups as U
from custos.operators import rules as R
from tests.helpers import catalog, urn

TRACE = "seq bigint, node string, status string, duration_ms double"


def lines(spark, cat, run, trace=()):
    found = R.findings(cat)
    rows = T.assessment_report(R.catalogue_verdict(cat), found, U.recommendations(found), spark.createDataFrame(list(trace), TRACE), run)
    return [r.line for r in rows.orderBy("part", "neg_score", "section_asset", "line_in_section").collect()]


def test_all_parts(spark):
    cat = catalog(spark, [dict(asset_id=1, urn=urn(1), name="a|b"), dict(asset_id=2, urn=urn(2), name="kept", description="d")],
                  ownership=[(2, 1, "urn:li:corpuser:x", "T")], fields=[(1, 1, "email", "T"), (2, 1, "phone_number", "T")])
    run = T.Run("Why?", "ask", "2024-01-01T00:00:00Z", 12.5, "rules", True, "In short.", "It matters.", ("one", "two"))
    got = lines(spark, cat, run, [(2, "owners", "failed", 0.49), (1, "datasets", "ok", 2.5)])
    assert got[:16] == ["# Governance Assessment", "", "> Generated from live catalogue metadata.", "", "**Question:** Why?", "", "| | |", "| --- | --- |",
                        "| Risk level | **CRITICAL** |", "| Risk score | 90 / 100 |", "| Findings | 4 |", "| Assets with findings | 2 |",
                        "| Intent classified as | `ask` |", "| Analysis duration | 13 ms |", "| Reasoning provider | rules |", "| Generated | 2024-01-01T00:00:00Z |"]
    rest = got[16:]
    order = [x for x in rest if x.startswith(("#", ">", "---", "| Status"))]
    assert order == ["| Status | **Degraded — partial evidence** |", "## Executive summary", "## Business impact", "## Findings", "### a|b", "### kept",
                     "> The catalogue score (**90**) is the worst asset's score, not the sum across assets.", "## Recommendations", "## Next steps",
                     "## How this was produced", "### Errors encountered", "---"]
    at = rest.index("| --- | --- | ---: |")
    assert rest[at - 1:at + 4] == ["| Stage | Status | Duration |", "| --- | --- | ---: |", "| datasets | ok | 3 ms |", "| owners | failed | 0 ms |", ""]
    assert "| | | **90** | 30 + 20 + 40 = 90 → **critical** |" in rest and rest[rest.index("- one") + 1] == "- two"
    assert sum(x.startswith("- ") for x in rest) == 3 + 2  # three next steps, two errors
    assert all(rest[i - 1] == "" for i, x in enumerate(rest) if x.startswith(("## ", "### ", "---")))


def test_a_clean_catalogue_has_no_findings_parts(spark):
    cat = catalog(spark, [dict(asset_id=1, urn=urn(1), name="a", description="d")], ownership=[(1, 1, "urn:li:corpuser:x", "T")])
    got = lines(spark, cat, T.Run("Why?", "ask", "now", 1, source="demo"))
    assert [x for x in got if x.startswith(("#", "---"))] == ["# Governance Assessment", "## How this was produced", "---"]
    assert got[2].startswith("> **Demo data.**") and not any("provider" in x or "Degraded" in x or "worst" in x for x in got)
