import pytest
from pyspark.sql import functions as F

from custos.functions import columns as C
from custos.operators import rules as R
from tests.helpers import catalog, urn

PII_YES = ["email", "user_email", "phone_number", "ssn", "date_of_birth", "dob", "home_address",
           "customer_first_name", "credit_card_number", "passport", "national_id"]
PII_NO = ["order_id", "created_at", "emailer_job_id", "quantity", "status"]


def test_pii_column_names(spark):
    df = spark.createDataFrame([(c,) for c in PII_YES + PII_NO], "c string")
    got = {r["c"]: r["p"] for r in df.select("c", C.looks_like_pii("c").alias("p")).collect()}
    assert all(got[c] for c in PII_YES)
    assert not any(got[c] for c in PII_NO)


def test_pii_tags(spark):
    yes, no = ["PII", "pii-sensitive", "GDPR", "Confidential"], ["tier-1", "certified", "finance"]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string")
    got = {r["t"]: r["p"] for r in df.select("t", C.is_pii_tag("t").alias("p")).collect()}
    assert all(got[t] for t in yes) and not any(got[t] for t in no)


def scores(spark, cat, ds=None, threshold=5):
    return {r["asset_id"]: r for r in R.asset_risk_score(cat, ds, threshold).collect()}


def test_each_rule_alone_and_all_together(spark):
    assets = [
        dict(asset_id=1, urn=urn(1), name="t1", description="documented"),                       # unowned only
        dict(asset_id=2, urn=urn(2), name="t2"),                                                  # owned, undocumented
        dict(asset_id=3, urn=urn(3), name="t3", description="d"),                                # owned, pii
        dict(asset_id=4, urn=urn(4), name="t4", description="d", deprecated=True),               # owned, deprecated+consumed
        dict(asset_id=5, urn=urn(5), name="t5", description="d", schema_drift=True),             # owned, drift
        dict(asset_id=6, urn=urn(6), name="t6", deprecated=True, schema_drift=True),             # everything
    ]
    own = [(a, a * 10, "urn:li:corpuser:x", "BUSINESS_OWNER") for a in (2, 3, 4, 5)]
    fields = [(3, 1, "customer_email", "VARCHAR"), (6, 1, "ssn", "VARCHAR")]
    cat = catalog(spark, assets, ownership=own, fields=fields)
    ds = spark.createDataFrame([(4, 3), (6, 9)], "asset_id bigint, downstream_count bigint")
    s = scores(spark, cat, ds)
    assert (s[1].raw_total, s[1].risk_level) == (30, "medium")
    assert (s[2].raw_total, s[2].risk_level) == (20, "medium")
    assert (s[3].raw_total, s[3].risk_level) == (40, "high")
    assert s[4].raw_total == 15
    assert s[5].raw_total == 15
    assert (s[6].raw_total, s[6].score, s[6].risk_level) == (140, 100, "critical")
    f = R.findings(cat, ds).where("asset_id = 6").orderBy("rule_order").collect()
    assert [r.rule for r in f] == ["missing_owner", "missing_documentation", "untagged_pii",
                                   "large_downstream_impact", "deprecated_in_use", "schema_drift"]
    assert sum(r.points for r in f) == 140


@pytest.mark.parametrize("score,level", [(0, "low"), (19, "low"), (20, "medium"), (39, "medium"),
                                         (40, "high"), (69, "high"), (70, "critical"), (100, "critical")])
def test_bands(spark, score, level):
    assert spark.range(1).select(C.risk_level(F.lit(score))).first()[0] == level


@pytest.mark.parametrize("n,fires", [(0, False), (4, False), (5, True), (6, True)])
def test_downstream_threshold(spark, n, fires):
    cat = catalog(spark, [dict(asset_id=1, urn=urn(1), name="a", description="d")],
                  ownership=[(1, 1, "urn:li:corpuser:a", "X")])
    ds = spark.createDataFrame([(1, n)], "asset_id bigint, downstream_count bigint")
    rules = {r.rule for r in R.findings(cat, ds).collect()}
    assert ("large_downstream_impact" in rules) is fires


def test_tunable_threshold(spark):
    cat = catalog(spark, [dict(asset_id=1, urn=urn(1), name="a", description="d")],
                  ownership=[(1, 1, "urn:li:corpuser:a", "X")])
    ds = spark.createDataFrame([(1, 3)], "asset_id bigint, downstream_count bigint")
    assert R.findings(cat, ds, threshold=3).count() == 1


def test_deprecated_without_consumers_is_not_a_finding(spark):
    cat = catalog(spark, [dict(asset_id=1, urn=urn(1), name="a", description="d", deprecated=True)],
                  ownership=[(1, 1, "urn:li:corpuser:a", "X")])
    assert R.findings(cat, None).count() == 0


def test_pii_detail_lists_five_and_more(spark):
    fields = [(1, i, f"c{i}_email", "VARCHAR") for i in range(1, 8)]
    cat = catalog(spark, [dict(asset_id=1, urn=urn(1), name="a", description="d")],
                  ownership=[(1, 1, "urn:li:corpuser:a", "X")], fields=fields)
    d = R.findings(cat).first().detail
    assert d.endswith("c1_email, c2_email, c3_email, c4_email, c5_email (+2 more).")


def test_pii_tag_suppresses_finding(spark):
    cat = catalog(spark, [dict(asset_id=1, urn=urn(1), name="a", description="d")],
                  ownership=[(1, 1, "urn:li:corpuser:a", "X")], tags=[(1, "GDPR")],
                  fields=[(1, 1, "email", "VARCHAR")])
    assert R.findings(cat).count() == 0


def test_blank_description_and_name_fallback(spark):
    cat = catalog(spark, [dict(asset_id=1, urn=urn(1, "x.y"), description="  \t ")])
    rows = R.findings(cat).collect()
    assert {r.rule for r in rows} == {"missing_owner", "missing_documentation"}
    assert rows[0].asset_name == "db.x.y"


def test_empty_catalogue_verdict(spark):
    cat = catalog(spark, [])
    v = R.catalogue_verdict(cat).first()
    assert (v.score, v.risk_level, v.total_findings) == (0, "low", 0)


def test_reproducible_under_shuffled_input(spark):
    assets = [dict(asset_id=i, urn=urn(i), name=f"t{i}", description=None if i % 2 else "d") for i in range(30)]
    a = sorted(map(tuple, R.findings(catalog(spark, assets)).collect()))
    b = sorted(map(tuple, R.findings(catalog(spark, list(reversed(assets)))).collect()))
    assert a == b


def test_shared_downstream_parity_and_statistics_drift(spark):
    assets = [dict(asset_id=i, urn=urn(i), name=f"t{i}", description="d") for i in (1, 2)]
    own = [(i, 1, "urn:li:corpuser:a", "X") for i in (1, 2)]
    cat = catalog(spark, assets, ownership=own)
    shared = R.scored_facts(cat, shared_downstream=7).collect()
    assert all(r.r_large_downstream_impact for r in shared)
    drift = spark.createDataFrame([(2, True)], "asset_id bigint, schema_drift boolean")
    got = {r.asset_id: r.r_schema_drift for r in R.scored_facts(cat, stats_drift=drift).collect()}
    assert got == {1: False, 2: True}
