"""Incremental rescore: after every batch the table is that of a full recompute, and only affected rows were written."""

import random

import pytest

from custos.operators import lineage, rules
from custos.streaming.rescore import ScoreTable
from tests.helpers import catalog, urn

DDL = "asset_id bigint"


class World:
    """A small catalogue in plain Python, changed at random."""

    def __init__(self, n, seed):
        self.rng = random.Random(seed)
        self.assets = {i: dict(asset_id=i, urn=urn(i), name=f"t{i}") for i in range(n)}
        self.owned, self.tagged, self.fields = set(), {}, {i: ["id"] for i in range(n)}
        self.edges = {(a, b) for a, b in ((self.rng.randrange(n), self.rng.randrange(n)) for _ in range(n)) if a != b}

    def catalog(self, spark):
        return catalog(spark, list(self.assets.values()), ownership=[(i, 1, "urn:li:corpuser:x", "T") for i in self.owned & set(self.assets)],
                       tags=[(i, t) for i, t in self.tagged.items()], fields=[(i, k, f, "T") for i, fs in self.fields.items() for k, f in enumerate(fs)],
                       edges=sorted(self.edges))

    def change(self):
        """(changed assets, changed edges)"""
        rng, ids, touched = self.rng, list(self.assets), set()
        for i in rng.sample(ids, 4):
            kind = rng.randrange(5)
            if kind == 0:
                self.owned ^= {i}
            elif kind == 1:
                self.assets[i]["description"] = None if self.assets[i].get("description") else "text"
            elif kind == 2:
                self.fields[i] = ["id", rng.choice(["email", "size"])]
            elif kind == 3:
                self.assets[i]["deprecated"] = not self.assets[i].get("deprecated")
            else:
                del self.assets[i]
            touched.add(i)
        new = len(ids) + 100 + rng.randrange(1000)
        self.assets[new] = dict(asset_id=new, urn=urn(new), name="new")
        gone = set(rng.sample(sorted(self.edges), min(3, len(self.edges))))
        added = {(a, b) for a, b in ((rng.choice(ids), rng.choice([*ids, new])) for _ in range(4)) if a != b} - self.edges
        self.edges = (self.edges - gone) | added
        return touched | {new}, gone | added


def expected(spark, cat):
    down = lineage.downstream_counts(cat)
    score = {r.asset_id: (r.score, r.risk_level, r.n_findings) for r in rules.asset_risk_score(cat, down).collect()}
    found = {}
    for r in rules.findings(cat, down).collect():
        found.setdefault(r.asset_id, []).append((r.rule, r.detail))
    return score, found


def current(table):
    rows = table.scores().collect()
    return ({r.asset_id: (r.score, r.risk_level, r.n_findings) for r in rows},
            {r.asset_id: [(f.rule, f.detail) for f in r.findings] for r in rows if r.findings})


def affected(world, touched, edges):
    seen, todo = {a for a, _ in edges}, [a for a, _ in edges]
    while todo:
        b = todo.pop()
        for a in {x for x, y in world.edges if y == b} - seen:
            seen.add(a)
            todo.append(a)
    return touched | seen


def test_batches_equal_a_full_recompute(spark, tmp_path):
    world = World(30, 5)
    table = ScoreTable(spark, str(tmp_path / "t"))
    cat = world.catalog(spark)
    assert table.start(cat)["scores"] == len(world.assets)
    assert current(table) == expected(spark, cat)
    for _ in range(2):
        touched, edges = world.change()
        cat = world.catalog(spark)
        told = table.apply(cat, spark.createDataFrame([(i,) for i in touched], DDL), spark.createDataFrame(sorted(edges), "src bigint, dst bigint"))
        assert current(table) == expected(spark, cat)
        assert told["scores"] == len(affected(world, touched, edges))  # no row more
    table.compact()
    assert current(table) == expected(spark, cat)


def test_a_cycle_opened_and_closed(spark, tmp_path):
    """Edges that join and part a cycle change all that reach it, and nobody below."""
    assets = [dict(asset_id=i, urn=urn(i)) for i in range(9)]
    base = [(0, 1), (1, 2), (2, 3), (3, 4), (5, 0), (4, 6), (6, 7)]
    table = ScoreTable(spark, str(tmp_path / "t"))
    table.start(catalog(spark, assets, edges=base))
    none, ddl = spark.createDataFrame([], DDL), "src bigint, dst bigint"
    closed = catalog(spark, assets, edges=[*base, (4, 0)])
    assert table.apply(closed, none, spark.createDataFrame([(4, 0)], ddl))["scores"] == 6  # 0 to 5
    assert current(table) == expected(spark, closed)
    opened = catalog(spark, assets, edges=base[1:])
    told = table.apply(opened, none, spark.createDataFrame([(4, 0), (0, 1)], ddl))
    assert current(table) == expected(spark, opened) and told["scores"] == 6


def test_replays_and_failures(spark, tmp_path, monkeypatch):
    assets = [dict(asset_id=i, urn=urn(i)) for i in range(4)]
    table = ScoreTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        table.apply(catalog(spark, assets), spark.createDataFrame([(1,)], DDL))
    table.start(catalog(spark, assets))
    owned = catalog(spark, assets, ownership=[(1, 1, "urn:li:corpuser:x", "T")])
    before = current(table)
    with monkeypatch.context() as m:
        m.setattr(table.log, "commit", lambda state: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.apply(owned, spark.createDataFrame([(1,)], DDL), batch=1)
    assert current(table) == before
    assert table.apply(owned, spark.createDataFrame([(1,), (1,), (None,)], DDL), batch=1) == {"scores": 1, "radius": 0}
    assert current(table) == expected(spark, owned)
    assert table.apply(owned, spark.createDataFrame([(1,)], DDL), batch=1) == {"scores": 0, "radius": 0}
    with pytest.raises(ValueError):
        table.apply(owned, spark.createDataFrame([(1,)], DDL), batch=5)
