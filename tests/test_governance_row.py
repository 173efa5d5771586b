import pytest

from custos.operators import assets as A
from custos.operators import rollups as U
from tests.helpers import catalog, urn


@pytest.fixture(scope="module")
def gov(spark):
    assets = [
        # owned, described, 2 tags, domain: coverage 100, doc 70+30=100, health 40+40+20=100
        dict(asset_id=1, urn=urn(1), name="full", description="d", domain_urn="urn:li:domain:a"),
        # nothing: coverage 0, doc 0, health 0
        dict(asset_id=2, urn=urn(2), name="bare"),
        # owned, deprecated, 1 tag: coverage 50, doc 15, health round(20+6+20)=46-15=31
        dict(asset_id=3, urn=urn(3), name="dep", deprecated=True),
        # described only: coverage 25, doc 70, health round(10+28)=38
        dict(asset_id=4, urn=urn(4), name="doc", description="d"),
    ]
    own = [(1, 1, "urn:li:corpuser:x", "BIZ"), (3, 1, "urn:li:corpuser:x", "BIZ")]
    tags = [(1, "a"), (1, "b"), (3, "c")]
    cat = catalog(spark, assets, ownership=own, tags=tags,
                  principals=[("urn:li:corpuser:x", "X", None, True)],
                  domains=[("urn:li:domain:a", "A"), ("urn:li:domain:empty", "Empty")])
    return cat, {r.asset_id: r for r in A.governance_assets(cat).collect()}


def test_governance_arithmetic(gov):
    _, g = gov
    assert (g[1].coverage, g[1].documentation, g[1].health, g[1].severity) == (100, 100, 100, "low")
    assert (g[2].coverage, g[2].documentation, g[2].health, g[2].severity) == (0, 0, 0, "critical")
    assert (g[3].coverage, g[3].documentation, g[3].health, g[3].severity) == (50, 15, 31, "critical")
    assert (g[4].coverage, g[4].documentation, g[4].health, g[4].severity) == (25, 70, 38, "critical")
    assert g[1].domain == "A" and g[2].domain == "Unassigned" and g[1].owner == "X"


def test_domain_counts_keep_empty_domains(spark, gov):
    cat, _ = gov
    counts = {r.domain_urn: r.entity_count for r in U.domain_counts(cat).collect()}
    assert counts == {"urn:li:domain:a": 1, "urn:li:domain:empty": 0}


def test_severity_share(spark, gov):
    cat, _ = gov
    g = A.governance_assets(cat)
    share = {r.severity: (r["count"], r.share) for r in U.severity_share(g).collect()}
    assert share == {"critical": (3, 75), "high": (0, 0), "medium": (0, 0), "low": (1, 25)}


def test_overview_and_entities(spark, gov):
    cat, _ = gov
    g = A.governance_assets(cat)
    m = U.overview_metrics(cat, g).first()
    assert (m.total_assets, m.healthy_assets, m.critical_issues, m.missing_owners) == (4, 1, 3, 2)
    assert m.score == 42  # round((100 + 0 + 31 + 38) / 4) = round(42.25)
    assert m.documentation_coverage == 50 and m.owners == 1 and m.domain_count == 2
    ents = {r.label: r["count"] for r in U.entity_counts(cat).collect()}
    assert ents["Datasets"] == 4 and ents["Platforms"] == 1


def test_a_hot_asset_is_spread_over_tasks(spark):
    """One asset with a third of all child rows: no joining task gets far more than its share."""
    from pyspark.sql import functions as F

    from custos.functions.joins import to_many
    one = spark.range(2000).withColumnRenamed("id", "asset_id")
    many = spark.range(60000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1500).alias("asset_id"),
                                     F.col("id").alias("item"))
    out = to_many(one, many, "asset_id")
    # ids not divisible by 3 leave 1,000 different remainders by 1,500; 7 is one of them
    assert out.count() == 60000 + 1000 and out.where("item is null").count() == 1000
    parts = to_many(one, many, "asset_id", "inner", salts=16).groupBy(F.pmod(F.hash("asset_id", F.xxhash64("item") % 16), F.lit(8))).count()
    sizes = [r["count"] for r in parts.collect()]
    assert max(sizes) <= 2 * sum(sizes) / 8


def test_equal_child_rows_of_a_hot_asset_are_spread(spark):
    """A third of the children are one row repeated on one asset; others have none, or null for a key."""
    from pyspark.sql import functions as F

    from custos.functions.joins import to_many
    one = spark.range(2000).withColumnRenamed("id", "asset_id")
    many = spark.range(60000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 1500).alias("asset_id"),
                                     F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("item"))
    plain = one.join(many, "asset_id", "left")
    for how in ("left", "inner"):
        out = to_many(one, many, "asset_id", how, hot_rows=100)
        want = plain if how == "left" else plain.where("item is not null")
        assert out.groupBy("asset_id", "item").count().exceptAll(want.groupBy("asset_id", "item").count()).isEmpty() and out.count() == want.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = to_many(one, many, "asset_id", "inner", hot_rows=100).where("asset_id = 7 and item = 'same'")
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 20000 and len(sizes) >= 8 and max(sizes) <= 2 * sum(sizes) / 8
