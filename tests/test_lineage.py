import duckdb
import pytest
from pyspark.sql import functions as F

from custos.operators import lineage as G
from tests.helpers import catalog, urn


def reach(spark, edges, roots=None, max_hops=3, hops_per_job=8, n_assets=10):
    cat = catalog(spark, [dict(asset_id=i, urn=urn(i), name=f"t{i}") for i in range(n_assets)], edges=edges)
    r = None if roots is None else spark.createDataFrame([(x,) for x in roots], "root bigint")
    out = G.reachability(cat, r, "DOWNSTREAM", max_hops, hops_per_job=hops_per_job)
    return sorted((x.root, x.node, x.degree) for x in out.collect())


def test_no_edges_is_empty(spark):
    assert reach(spark, []) == []


def test_self_loop_and_two_cycle_terminate(spark):
    got = reach(spark, [(1, 1), (1, 2), (2, 1)], roots=[1], max_hops=None)
    assert got == [(1, 2, 1)]


def test_diamond_keeps_minimum_degree(spark):
    got = reach(spark, [(1, 2), (2, 4), (1, 3), (3, 5), (5, 4)], roots=[1], max_hops=None)
    assert (1, 4, 2) in got and (1, 5, 2) in got and len(got) == 4


@pytest.mark.parametrize("hops_per_job", [1, 2, 8])
def test_chain_longer_than_max_hops(spark, hops_per_job):
    edges = [(i, i + 1) for i in range(9)]
    got = reach(spark, edges, roots=[0], max_hops=3, hops_per_job=hops_per_job)
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    full = reach(spark, edges, roots=[0], max_hops=None, hops_per_job=hops_per_job)
    assert full == [(0, i, i) for i in range(1, 10)]


def test_all_roots_equals_recursive_sql(spark):
    import random
    rnd = random.Random(7)
    edges = sorted({(rnd.randrange(30), rnd.randrange(30)) for _ in range(80)})
    got = reach(spark, edges, None, 3, n_assets=30)
    con = duckdb.connect()
    con.execute("CREATE TABLE e(src BIGINT, dst BIGINT)")
    con.executemany("INSERT INTO e VALUES (?, ?)", edges)
    want = con.execute("""
      WITH RECURSIVE r(root, node, degree) AS (
        SELECT src, dst, 1 FROM e WHERE src <> dst
        UNION SELECT r.root, e.dst, r.degree + 1 FROM r JOIN e ON e.src = r.node WHERE r.degree < 3 AND e.dst <> r.root)
      SELECT root, node, min(degree) FROM r GROUP BY root, node ORDER BY 1, 2""").fetchall()
    assert got == [tuple(x) for x in want]


def test_edge_to_unknown_asset_is_dropped_from_node_table(spark):
    cat = catalog(spark, [dict(asset_id=1, urn=urn(1), name="a")], edges=[(1, 99)])
    root = spark.createDataFrame([(1,)], "root bigint")
    assert G.lineage_from_root(cat, "DOWNSTREAM", None, root).count() == 0
    assert G.reachability(cat, root, "DOWNSTREAM", None).count() == 1


def test_upstream_direction_and_totals(spark):
    cat = catalog(spark, [dict(asset_id=i, urn=urn(i), name=f"t{i}") for i in range(5)],
                  edges=[(0, 1), (1, 2), (3, 2), (2, 4)])
    root = spark.createDataFrame([(2,)], "root bigint")
    t = G.lineage_totals(cat, root).first()
    assert (t.downstream_total, t.upstream_total) == (1, 3)
    lonely = spark.createDataFrame([(0,)], "root bigint")
    assert G.lineage_totals(cat, lonely).first().upstream_total == 0


def test_graph_tables_are_star_shaped(spark):
    cat = catalog(spark, [dict(asset_id=i, urn=urn(i), name=f"t{i}") for i in range(4)],
                  edges=[(0, 1), (1, 2), (2, 3)])
    nodes, edges = G.lineage_graph(cat, None, spark.createDataFrame([(1,)], "root bigint"))
    assert nodes.where("is_root").count() == 1 and nodes.count() == 4
    assert {(e.source, e.target) for e in edges.collect()} == {
        (urn(0), urn(1)), (urn(1), urn(2)), (urn(1), urn(3))}


@pytest.mark.parametrize("max_hops", [None, 2, 4, 7])
def test_rooted_equals_hop_by_hop(spark, max_hops):
    edges = random_edges(40, 90, 11)
    cat = catalog(spark, [dict(asset_id=i, urn=urn(i), name=f"t{i}") for i in range(40)], edges=edges)
    roots = spark.createDataFrame([(0,), (5,), (17,)], "root bigint")
    want = sorted(map(tuple, G.reachability(cat, roots, "DOWNSTREAM", max_hops, hops_per_job=1)
                      .select("root", "node", "degree").collect()))
    got = sorted(map(tuple, G.rooted_reachability(cat, roots, "DOWNSTREAM", max_hops)
                     .select("root", "node", "degree").collect()))
    assert got == want


def random_edges(nodes, n, seed):
    import random
    rnd = random.Random(seed)
    return sorted({(rnd.randrange(nodes), rnd.randrange(nodes)) for _ in range(n)})


def descendants(edges):
    out = {}
    for s, d in edges:
        out.setdefault(s, set()).add(d)
    reach = {}
    for root in out:
        todo, seen = [root], set()
        while todo:
            for d in out.get(todo.pop(), ()):
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        reach[root] = seen - {root}
    return {k: len(v) for k, v in reach.items() if v}


def test_long_chain_is_counted_to_its_end(spark):
    cat = catalog(spark, [dict(asset_id=i, urn=urn(i)) for i in range(12)], edges=[(i, i + 1) for i in range(11)])
    got = {r.asset_id: r.downstream_count for r in G.downstream_counts(cat).collect()}
    assert got == {i: 11 - i for i in range(11)}


@pytest.mark.parametrize("most", [1, 3, 5])
def test_threshold_is_exact_on_cyclic_graphs(spark, most):
    edges = random_edges(40, 60, 3) + [(100, 101), (101, 102), (102, 100), (103, 103)]
    cat = catalog(spark, [dict(asset_id=0, urn=urn(0))], edges=edges)
    got = {r.node: r.n for r in G.some_descendants(cat, most).collect()}
    assert got == {k: min(v, most) for k, v in descendants(edges).items()}


def test_blast_radius_whole_depth_on_the_fixture(spark):
    from custos.sources.catalog import Catalog
    from tests.conftest import SF_SMALL
    cat = Catalog.from_testdata(spark, SF_SMALL)
    want = descendants([tuple(r) for r in cat.lineage_edges.select("src", "dst").collect()])
    assert {r.asset_id: r.downstream_count for r in G.downstream_counts(cat).collect()} == want
    approx = {r.asset_id: r.downstream_count for r in G.downstream_counts_approx(cat).collect()}
    assert set(approx) == set(want)
    assert max(abs(approx[k] - v) / v for k, v in want.items()) < 0.05


def test_nodes_on_cycles_do_not_count_themselves(spark):
    edges = [*random_edges(40, 60, 3), (100, 101), (101, 102), (102, 100), (103, 103), (104, 100)]
    cat = catalog(spark, [dict(asset_id=0, urn=urn(0))], edges=edges)
    assert {r.node: r.n for r in G.descendant_sketches(cat).collect()} == descendants(edges)
    assert {r.asset_id: r.downstream_count for r in G.downstream_counts(cat).collect()} == descendants(edges)


def test_sketches_spread_as_long_as_registers_change(spark):
    # a hub of many members past list mode, and members that come in late by a chain, one a round
    from pyspark.sql import functions as F
    late = list(range(1000, 1030))
    edges = [(0, 1), (1, 2), (2, 3)] + [(3, 100 + i) for i in range(60)] + list(zip([3, *late], late, strict=False))
    cat = catalog(spark, [dict(asset_id=0, urn=urn(0))], edges=edges)
    got = {r.node: r.n for r in G.descendant_sketches(cat, lg_config_k=5).collect()}
    found = spark.createDataFrame([(n % 2, n) for n in {d for _, d in edges if d > 3}], "part int, dst bigint")
    for node in (2, 1, 0):  # the sketch of all descendants, merged from parts as in the rounds
        found = found.union(spark.createDataFrame([(0, node + 1)], "part int, dst bigint"))
        want = found.groupBy("part").agg(F.hll_sketch_agg("dst", 5).alias("sk")).agg(F.hll_sketch_estimate(F.hll_union_agg("sk")).alias("n"))
        assert got[node] == want.first().n


def test_explicit_hop_bound(spark):
    cat = catalog(spark, [dict(asset_id=0, urn=urn(0))], edges=[(i, i + 1) for i in range(6)])
    got = {r.asset_id: r.downstream_count for r in G.downstream_counts(cat, max_hops=2).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 2, 5: 1}
