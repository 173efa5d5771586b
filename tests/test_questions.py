import pytest

from custos.operators import questions as Q

CASES = [
    ("Find datasets without owners", "find_missing_owners"),
    ("Which assets are unowned?", "find_missing_owners"),
    ("who owns fct_payments", "find_missing_owners"),
    ("Show downstream impact of dim_customer", "analyze_lineage"),
    ("Explain the lineage", "analyze_lineage"),
    ("Which datasets are highest risk?", "find_risky_datasets"),
    ("Find untagged PII", "find_risky_datasets"),
    ("Generate documentation for stg_orders", "generate_documentation"),
    ("Write a README", "generate_documentation"),
    ("Create a governance report", "generate_report"),
    ("Give me an executive summary", "generate_report"),
    ("Analyze governance health", "analyze_governance"),
    ("Create a governance report for this week", "generate_report"),
    ("   ", "unknown"),
    ("hello there", "unknown"),
]


@pytest.fixture(scope="module")
def classified(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(CASES)], "question_id long, question string")
    return {r.question_id: r for r in Q.classify_questions(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_intents(classified, i):
    assert classified[i].intent == CASES[i][1]


def test_reasons_and_confidence(classified):
    assert classified[13].reason == "Empty question." and classified[13].confident is False
    assert classified[14].reason == "No governance keywords matched."
    assert classified[0].reason == "Matched 'without owner' → find_missing_owners."
    assert classified[0].confident is True


def test_targets(spark):
    df = spark.createDataFrame([
        (1, "Impact of urn:li:dataset:(urn:li:dataPlatform:dbt,a.b,PROD) please"),
        (2, "who owns fct_payments"),
        (3, "Show the risk_score of finance.stg_orders"),
        (4, "Explain the lineage"),
        (5, "show tables"),
    ], "question_id long, question string")
    got = {r.question_id: (r.target_urn, r.target_name) for r in Q.question_target(df).collect()}
    assert got[1] == ("urn:li:dataset:(urn:li:dataPlatform:dbt,a.b,PROD)", None)
    assert got[2] == (None, "fct_payments")
    assert got[3] == (None, "risk_score")
    assert got[4] == (None, None)
    assert got[5] == (None, None)


def test_plan_adds_lineage_for_named_target_and_recommendation(spark):
    df = spark.createDataFrame([(1, "Find datasets without owners"), (2, "who owns fct_payments"),
                                (3, "Generate documentation for stg_orders")], "question_id long, question string")
    got = {r.question_id: r.plan for r in Q.question_plan(df).collect()}
    assert got[1] == "datasets,owners,risk,reasoning,recommendation"
    assert got[2] == "datasets,owners,lineage,risk,reasoning,recommendation"
    assert got[3] == "datasets,statistics,reasoning"
