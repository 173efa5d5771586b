"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from custos.llm import neighbours

KIND = "vec_id bigint, embedding array<float>, score double, rank int"


def brute(rows, queries, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in good:
            near = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = [(i, d) for d, i in near[:k]]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("shard_rows", [200, 4096])
def test_recall_and_exact_scores(spark, shard_rows):
    rng = np.random.Generator(np.random.PCG64(0))
    x = (rng.normal(size=(8, 16))[rng.integers(8, size=900)] + rng.normal(size=(900, 16)) * 0.4).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 0.0, 1) for i, v in rows], KIND)
    got = result(neighbours.nearest(df, df.where("vec_id % 50 = 0"), k=10, shard_rows=shard_rows, block_rows=7))
    want = brute(rows, range(0, 900, 50), 10)
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.97
    for q, near in got.items():
        assert near == sorted(near, key=lambda p: (p[1], p[0]))
        for i, d in near:
            assert d == pytest.approx(float(np.sqrt(((x[i].astype(float) - x[q]) ** 2).sum())), abs=1e-12)


@pytest.mark.parametrize("scale, shift", [(1, 0), (1e20, 0), (1e-25, 0), (1, 1e4), (1e180, 0), (1e-180, 0), (1e307, 0)])
def test_recall_at_any_magnitude_and_offset(spark, scale, shift):
    """Values whose squares leave the range of doubles, and offsets that hide the differences from single precision."""
    rng = np.random.Generator(np.random.PCG64(1))
    x = np.clip(rng.normal(size=(6, 12))[rng.integers(6, size=500)] + rng.normal(size=(500, 12)) * 0.4, -9, 9) * scale + shift
    df = spark.createDataFrame([(i, v.tolist(), 0.0, 1) for i, v in enumerate(x)], KIND.replace("float", "double"))
    got = result(neighbours.nearest(df, df.where("vec_id % 25 = 0"), k=10, shard_rows=250))
    want = brute(list(enumerate((x / scale).tolist())), range(0, 500, 25), 10)
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.95
    for q, near in got.items():
        for i, d in near:
            assert d / scale == pytest.approx(float(np.sqrt(((x[i] / scale - x[q] / scale) ** 2).sum())), rel=1e-9)


def test_copies_ties_and_bad_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100, [0.0, 0.0]), (101, None), (102, [1.0, None]), (103, [float("nan"), 1.0]),
            (104, [float("inf"), 1.0]), (105, []), (106, [1.0, 2.0, 3.0]), (None, [1.0, 0.5]), (107, [1.0, 1.0]), (107, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0.0, 1) for i, v in rows], KIND)
    got = result(neighbours.nearest(df, df, k=4))
    assert got[3] == [(0, 0.0), (1, 0.0), (2, 0.0), (4, 0.0)] and got[107] == [(i, 1.0) for i in range(4)]
    assert set(got) == {*range(30), 107}


def test_empty_table(spark):
    df = spark.createDataFrame([], KIND)
    assert neighbours.nearest(df, df).count() == 0
