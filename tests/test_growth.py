"""What a query reads, writes and sends round: only what it needs, whatever the size of the tables."""

from pyspark.sql import functions as F

from custos.functions.tables import Workspace
from custos.operators import assets as A
from custos.operators import condense, intervals
from custos.operators import lineage as G
from custos.sources import catalog as S
from custos.streaming import rescore
from tests.helpers import catalog, urn


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def small(spark, edges=((1, 2), (1, 2), (2, 3))):
    return catalog(spark, [dict(asset_id=i, urn=urn(i), name=f"t{i}") for i in (1, 2, 3)], edges=edges)


def test_a_derived_table_is_prepared_when_it_is_used(spark, monkeypatch):
    written = []
    write = S.Catalog._written
    monkeypatch.setattr(S.Catalog, "_written", lambda self, name, *a: written.append(name) or write(self, name, *a))
    base = small(spark)
    cat = S.DerivedCatalog(base)
    assert cat.asset_tags.count() == 0 and written == []  # read where it lies
    assert sorted(map(tuple, cat.lineage_edges.collect())) == [(1, 2), (1, 2), (2, 3)]
    other = cat.with_tables(asset_tags=spark.createDataFrame([(1, "x")], "asset_id bigint, tag string"))
    assert other.lineage_edges is cat.lineage_edges and other.asset_tags.count() == 1 and cat.asset_tags.count() == 0
    assert written == ["lineage_edges"]
    assert A.clean_assets(other).count() == 3 and written == ["lineage_edges", "assets"]
    assert "asset_tags" in other.table_names() and "usage_events" not in other.table_names()


def test_descendants_are_searched_only_where_they_are_few_and_until_none_is_found(spark, monkeypatch):
    # 0 has six consumers; 10 leads to it, and 20 to one node alone
    cat = small(spark, [(0, i) for i in range(1, 7)] + [(10, 0), (20, 21)])
    rounds = []
    cut = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df, name="frame": rounds.append(name) or cut(df, name))
    want = {0: 5, 10: 5, 20: 1}
    assert {r.node: r.n for r in G.some_descendants(cat, 5).collect()} == want
    assert rounds.count("descendants") <= 4
    among = spark.createDataFrame([(0, True), (10, False), (20, False)], "node bigint, many boolean")
    assert {r.node: r.n for r in G.some_descendants(cat, 5, among=among).collect()} == {10: 5, 20: 1}
    got = {r.asset_id: r.downstream_count for r in G.downstream_counts(cat).collect()}
    assert got == {0: 6, 10: 7, 20: 1}


def test_levels_send_no_table_of_all_nodes_to_the_driver(spark, monkeypatch):
    made = []
    table = Workspace.table
    monkeypatch.setattr(Workspace, "table", lambda self, df, *a, **k: made.append(plan(df)) or table(self, df, *a, **k))
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4)], "src bigint, dst bigint")
    with Workspace(spark) as w:
        edges = w.table(edges)
        got = {r.node: r.level for r in condense.levels(edges, w).collect()}
    assert got == {1: 3, 2: 2, 3: 1, 4: 0}
    rounds = [p for p in made if "done" in p]
    assert rounds and all(p.count("Join") == 1 for p in rounds)  # the nodes placed last; no table of all nodes


def test_owner_labels_are_looked_up_for_first_owners_only(spark):
    cat = catalog(spark, [dict(asset_id=1, urn=urn(1))], principals=[
        ("urn:li:corpuser:a", "Ann", None, True), ("urn:li:corpuser:a", "Bea", None, True), ("urn:li:corpuser:b", None, None, True)],
        ownership=[(1, 2, "urn:li:corpuser:a", "X"), (1, 1, "urn:li:corpuser:a", "X"), (1, 3, "urn:li:corpuser:b", None), (2, 1, "urn:li:corpuser:c", "X")])
    stats = A.owner_stats(cat)
    # two entries of one principal count twice, as ever
    assert sorted((r.asset_id, r.n_owners, r.first_owner_urn, r.owner) for r in stats.collect()) == [
        (1, 3, "urn:li:corpuser:a", "Ann"), (2, 1, "urn:li:corpuser:c", None)]
    by_asset = [line for line in plan(stats).splitlines() if "Aggregate [asset_id" in line and "first_owner" in line]
    assert by_asset and "display_name" not in by_asset[0]


def test_history_shuffles_numbers_of_scans_and_sorts_rows_once(spark):
    seen = spark.createDataFrame([(1, "b", "s1"), (1, "a", "s1"), (1, "a", "s2"), (1, "c", "s3"), (2, None, "s1"), (2, None, "s3")], "k bigint, v string, scan string")
    scans = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "scan string")
    h = intervals.from_scans(seen, scans, ["k"], ["v"])
    assert sorted(map(str, map(tuple, h.collect()))) == sorted(map(str, [
        (1, "a", "s1", "s3"), (1, "c", "s3", None), (2, None, "s1", "s2"), (2, None, "s3", None)]))
    windows = [line for line in plan(h).splitlines() if " Window [" in line or "+- Window [" in line]
    assert windows and not any("valid_to" in line or "scan" in line for line in windows)
    assert "SortAggregate" not in h._jdf.queryExecution().executedPlan().toString()


def test_edges_of_the_derived_catalogue(spark, tmp_dir):
    """Targets outside the parts, repeats and nulls go; the join is none of copies with copies."""
    day = F.lit("1995-01-01").cast("date")
    for name, rows, ddl in (("part", [(1, 1), (15, 2), (15, 2), (28, 3)], "p_partkey bigint, p_size int"),
                            ("lineitem", [(1, 1), (1, 1), (1, 2), (1, 3), (None, 1), (15, 7), (1, None)], "l_partkey bigint, l_linenumber int"),
                            ("supplier", [(1,)], "s_suppkey bigint"), ("events", [(1,)], "event_id bigint")):
        df = spark.createDataFrame(rows, ddl)
        if name == "part":
            df = df.select("*", *[F.lit("x").alias(c) for c in ("p_name", "p_type", "p_brand")])
        if name == "lineitem":
            df = df.select("*", *[F.lit(1).cast("bigint").alias(c) for c in ("l_orderkey", "l_suppkey", "l_quantity")], F.lit("R").alias("l_returnflag"), day.alias("l_shipdate"))
        if name == "supplier":
            df = df.select("*", F.lit("s").alias("s_name"), F.lit(1.0).alias("s_acctbal"))
        if name == "events":
            df = df.select("*", F.lit(1).cast("bigint").alias("user_id"), day.alias("ts"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"))
        df.write.parquet(f"{tmp_dir}/{name}.parquet")
    edges = S.derive_catalog(spark, tmp_dir).lineage_edges
    assert sorted(map(tuple, edges.collect())) == [(1, 15), (1, 28)]


def test_sketches_are_written_once_and_not_moved_to_score(spark, tmp_path, monkeypatch):
    made, rows = [], []
    table, newest = Workspace.table, rescore._newest
    monkeypatch.setattr(Workspace, "table", lambda self, df, *a, **k: made.append(df.columns) or table(self, df, *a, **k))
    monkeypatch.setattr(rescore, "_newest", lambda df, key: rows.append(df.columns) or newest(df, key))
    scores = rescore.ScoreTable(spark, str(tmp_path / "t"))
    scores.start(small(spark, [(1, 2), (2, 3), (3, 1), (4, 1), (4, 5)]))
    assert any("sketch" in c for c in made) and not any("sketch" in c and "node" in c for c in made)
    assert rows and not any("sketch" in c for c in rows)  # the numbers alone are looked up
    assert "findings:" not in scores.scores(findings=False)._jdf.queryExecution().executedPlan().toString()
    assert {r.node: r.n for r in condense.sketches(small(spark).lineage_edges).collect()} == {1: 2, 2: 1, 3: 0}
    assert {r.node: r.n for r in condense.sketches(small(spark, [(1, 2), (2, 3), (3, 1), (4, 1), (4, 5)]).lineage_edges).collect()} == {
        1: 2, 2: 2, 3: 2, 4: 4, 5: 0}


def test_nodes_with_enough_descendants_are_left_alone(spark, monkeypatch):
    asked = []
    table = Workspace.table
    monkeypatch.setattr(Workspace, "table", lambda self, df, *a, **k: asked.append(t := table(self, df, *a, **k)) or t)
    edges = spark.createDataFrame([*[(0, i) for i in range(1, 7)], (10, 0), (20, 21), (30, 20), (20, 30)], "src bigint, dst bigint")
    known = spark.createDataFrame([(21, [40, 41])], "node bigint, few array<bigint>")
    with Workspace(spark) as w:
        got = {r.node: r.few for r in rescore.few_descendants(edges, 5, w, known).collect()}
        sources = [{r.src for r in t.collect()} for t in asked if t.columns == ["src", "dst"]]
    assert len(got[0]) == len(got[10]) == 5 and got[20] == [21, 30, 40, 41] and got[30] == [20, 21, 40, 41]
    assert sources and 0 not in sources[0] and 10 not in sources[1] and len(sources) <= 3
