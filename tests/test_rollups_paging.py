import random
import statistics

import pytest
from pyspark.sql import functions as F

from custos.operators import assets as A
from custos.operators import profile as P
from custos.operators import rollups as U
from tests.helpers import catalog, urn


@pytest.mark.parametrize("start,count,expect", [(-5, None, (0, 20)), (0, 0, (0, 1)), (3, 201, (3, 200)),
                                                (10, 50, (10, 50))])
def test_page_clamp(start, count, expect):
    assert A.clamp_page(start, count) == expect


def test_pages_and_past_the_end(spark):
    df = spark.range(45).select(F.col("id").alias("asset_id"), F.format_string("n%03d", "id").alias("name"),
                                F.col("id").cast("string").alias("urn"))
    last = A.asset_page(df, 40, 20).collect()
    assert [r.asset_id for r in last] == [40, 41, 42, 43, 44] and not last[0].has_more
    assert A.asset_page(df, 100, 20).count() == 0
    first = A.asset_page(df, 0, 20).collect()
    assert first[0].has_more and first[0].total == 45 and [r.row_index for r in first] == list(range(20))


def test_empty_catalogue_rollups(spark):
    cat = catalog(spark, [])
    gov = A.governance_assets(cat)
    cov = U.facet_coverage(gov).collect()
    assert all(r.percent is None and r.total == 0 for r in cov)
    m = U.overview_metrics(cat, gov).first()
    assert (m.documentation_coverage, m.score, m.total_assets) == (0, 0, 0)
    assert {r.severity: r["count"] for r in U.severity_counts(gov).collect()} == {
        "critical": 0, "high": 0, "medium": 0, "low": 0}


def test_owner_dedupe_and_dangling_owner(spark):
    cat = catalog(spark, [dict(asset_id=1, urn=urn(1), name="a")],
                  ownership=[(1, 2, "urn:li:corpuser:x", "TECH"), (1, 1, "urn:li:corpuser:x", "BIZ"),
                             (1, 3, "urn:li:corpuser:gone", "BIZ"), (1, 4, None, "BIZ")],
                  principals=[("urn:li:corpuser:x", "X", None, True)])
    owners = A.asset_owners(cat).orderBy("pos").collect()
    assert [(o.owner_urn, o.pos, o.ownership_type) for o in owners] == [
        ("urn:li:corpuser:x", 1, "BIZ"), ("urn:li:corpuser:gone", 3, "BIZ")]
    facet = {r.owner_urn: r for r in U.owner_facet(cat).collect()}
    assert facet["urn:li:corpuser:gone"].dangling and facet["urn:li:corpuser:gone"].kind == "USER"


def test_exact_median_matches_brute_force(spark):
    rnd = random.Random(3)
    vals = {"a": [rnd.randint(0, 50) for _ in range(501)], "b": [rnd.random() for _ in range(1000)],
            "c": [5.0]}
    rows = [(k, float(v)) for k, vs in vals.items() for v in vs]
    df = spark.createDataFrame(rows, "column_name string, v double")
    got = {r.column_name: r.median for r in P.exact_medians(df, partitions=7).collect()}
    for k, vs in vals.items():
        assert got[k] == pytest.approx(statistics.median(vs))


def test_median_does_not_rest_on_exchange_reuse(spark):
    from tests.conftest import SF_SMALL
    v = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").selectExpr("'k' column_name", "cast(l_extendedprice as double) v")
    want = P.exact_medians(v, partitions=7).collect()
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert P.exact_medians(v, partitions=7).collect() == want
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert want[0].median == pytest.approx(v.selectExpr("percentile(v, 0.5)").first()[0])
