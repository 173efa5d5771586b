from custos.plans.analyze import analyze
from custos.sources.catalog import Catalog
from tests.conftest import SF_SMALL


def test_owner_question_composes_only_planned_frames(spark):
    cat = Catalog.from_testdata(spark, SF_SMALL)
    ans = analyze(cat, "Find datasets without owners")
    assert ans.intent == "find_missing_owners" and "lineage" not in ans.plan
    assert {"datasets", "owners", "findings", "verdict", "recommendations"} <= set(ans.frames)
    assert "lineage" not in ans.frames and "statistics" not in ans.frames
    assert ans.frames["verdict"].first().score >= 0


def test_named_target_adds_lineage(spark):
    cat = Catalog.from_testdata(spark, SF_SMALL)
    name = cat.assets.where("name is not null").orderBy("asset_id").first().name.lower()
    ans = analyze(cat, f"Which datasets are highest risk? check {name}")
    assert ans.target_name == name and "lineage" in ans.frames
    names = [r.name.lower() for r in ans.frames["datasets"].collect()]
    assert name in names and all(name in n or name in u.lower()
                                 for n, u in ((r.name.lower(), r.urn) for r in ans.frames["datasets"].collect()))


def test_unknown_name_falls_back_to_a_scan(spark):
    cat = Catalog.from_testdata(spark, SF_SMALL)
    ans = analyze(cat, "Which datasets are highest risk? check fct_no_such_table")
    assert ans.target_name and ans.frames["datasets"].count() == cat.assets.count()
    assert ans.frames["verdict"].first().assets_examined == cat.assets.count()


def test_named_urn_is_looked_up_and_children_are_cut(spark):
    cat = Catalog.from_testdata(spark, SF_SMALL)
    row = cat.assets.orderBy("asset_id").first()
    ans = analyze(cat, f"Which datasets are highest risk? {row.urn}")
    assert ans.target_urn == row.urn and [r.asset_id for r in ans.frames["datasets"].collect()] == [row.asset_id]
    assert "EqualTo(urn," in ans.frames["datasets"]._jdf.queryExecution().executedPlan().toString()
    assert ans.frames["verdict"].first().assets_examined == 1
