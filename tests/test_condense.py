"""Components and blast radius on graphs with and without cycles, against plain searches."""

import random

import pytest

from custos.functions.tables import Workspace
from custos.operators import condense as D


def reach(edges):
    """Descendants of every node, itself never included."""
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
    found = {}
    for start in out:
        seen, todo = set(), [start]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        found[start] = seen
    return found


def ring(first, n):
    return [(first + i, first + (i + 1) % n) for i in range(n)]


def shuffled(edges, seed=0):
    """The same graph under other names, so that least and greatest identifiers lie anywhere."""
    rng, names = random.Random(seed), sorted({x for e in edges for x in e})
    new = dict(zip(names, rng.sample(range(10_000), len(names))))
    return [(new[a], new[b]) for a, b in edges]


rnd = random.Random(4)
GRAPHS = {
    "acyclic": [(i, j) for i in range(30) for j in range(i + 1, 30) if rnd.random() < 0.15],
    "two rings and a bridge": ring(0, 40) + ring(100, 3) + [(5, 100), (101, 200), (200, 201), (300, 7)],
    "rings that share a node": ring(0, 6) + [(0, 50), (50, 51), (51, 0), (0, 60), (60, 61)],
    "dense": [(rnd.randrange(25), rnd.randrange(25)) for _ in range(60)],
    "sparse": [(rnd.randrange(60), rnd.randrange(60)) for _ in range(75)],
    "ladder of rings": [e for k in range(5) for e in [*ring(10 * k, 4), (10 * k, 10 * k + 11)]],
    "a run between two rings": ring(0, 3) + ring(10, 3) + [(0, 5), (5, 6), (6, 10)],
    "loops and repeats": [(1, 1), (1, 2), (1, 2), (2, 3), (3, 3), (3, 2)],
}


# all of them as one graph, each under names of its own
ALL = [(1_000_000 * i + a, 1_000_000 * i + b) for i, name in enumerate(GRAPHS) for a, b in shuffled(GRAPHS[name], i)]


def test_numbers_equal_a_search_from_every_node(spark):
    got = {r.node: r.n for r in D.blast_radius(spark.createDataFrame(ALL + [(None, 1), (1, None)], "src bigint, dst bigint")).collect()}
    assert got == {a: n for a, seen in reach(ALL).items() if (n := len(seen - {a}))}


def test_an_acyclic_graph(spark):
    edges = shuffled(GRAPHS["acyclic"])
    got = {r.node: r.n for r in D.blast_radius(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {a: len(seen) for a, seen in reach(edges).items()}


def test_components_are_nodes_that_reach_each_other(spark):
    edges = sorted({e for e in ALL if e[0] != e[1]})
    seen = reach(edges)
    want = {a: min(x for x in seen[a] if a in seen.get(x, ())) for a in seen if a in seen[a]}
    with Workspace(spark) as w:
        got = [(r.node, r.component) for r in D.components(w.table(spark.createDataFrame(edges, "src bigint, dst bigint")), w).collect()]
    assert dict(got) == want and len(got) == len(want)


def test_a_large_cycle_takes_few_rounds_and_counts_all_but_itself(spark, monkeypatch):
    made = []
    table = Workspace.table
    monkeypatch.setattr(Workspace, "table", lambda self, *a, **k: made.append(1) or table(self, *a, **k))
    edges = ring(0, 1200) + [(7, 5000), (5000, 5001), (9000, 3)]
    got = {r.node: r.n for r in D.blast_radius(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {**{i: 1201 for i in range(1200)}, 5000: 1, 9000: 1202} and len(made) < 60


def test_each_sketch_is_written_once(spark, monkeypatch):
    """What the levels write adds up to one row a component, however many rounds there are."""
    rows = []
    table = Workspace.table

    def counted(self, df, *a, **k):
        out = table(self, df, *a, **k)
        if "sketch" in df.columns:
            rows.append(out.count())
        return out
    monkeypatch.setattr(Workspace, "table", counted)
    edges = [(i, j) for i in range(40) for j in (2 * i + 1, 2 * i + 2)] + [(i, i + 1) for i in range(20)]
    D.blast_radius(spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert sum(rows) == len({a for a, _ in edges})


def test_estimates_beyond_the_list(spark):
    """A hub over 5,000 nodes and a chain above it: within the stated error."""
    hub = spark.range(5000).selectExpr("1000000L src", "id dst").union(spark.range(3).selectExpr("2000000L + id src", "case when id = 0 then 1000000L else 1999999L + id end dst"))
    got = {r.node: r.n for r in D.blast_radius(hub).collect()}
    assert set(got) == {1000000, 2000000, 2000001, 2000002}
    assert got[1000000] == pytest.approx(5000, rel=0.03) and got[2000002] == pytest.approx(5003, rel=0.03)


def test_no_edges(spark):
    assert D.blast_radius(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0
