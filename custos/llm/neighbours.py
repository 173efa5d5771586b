"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Different vectors are dealt to shards by hash, about ``shard_rows`` each. A shard's
graph is built by inserting its vectors in order of their hash: each gets a random
level (geometric), and on every level up to it links to ``m`` diverse ones of its
``ef_build`` nearest among the vectors inserted before (a candidate is taken if it is
nearer to the new vector than to any neighbour taken already); links go both ways
and a full list is thinned by the same rule. The nearest earlier vectors come
from blocks of the shard's distance matrix, which a shard's size bounds. The graph is
stored as flat arrays in one table row a shard: vectors, and per level
the members and an n by 2m (level 0) or m matrix of neighbours, padded with -1.

Graph and search work on vectors that are centred and scaled by the shard's own mean and range, in double precision, so that
neither a common offset nor the magnitude of the components matters; distances returned are of the original vectors.

A query descends greedily from the entry point to level 1 and widens to the ``ef`` best on level 0. A shard's graph is sent
once, to the task that searches it; the queries follow it there in one sorted stream, so that a task holds a graph and a batch of
queries, and nothing is copied for each block of queries. Candidates get exact distances in double precision from the original
vectors, and shard results are merged by a ranked window. Every query meets every shard: for N vectors, Q queries and shards of
S vectors the search costs Q * N / S visits of a graph, and a graph is sent once for every ``block_rows`` queries.

Rows: vectors that are null, empty, all zero, or that hold null or non-finite components take no part,
nor do rows without vec_id. Equal vectors are one node with its ``k`` + 1 smallest ids, so
copies cost nothing and none that can be a result is lost. Repeated rows count once.
Vectors of different length never meet. Fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custos.llm.scratch import Scratch, map_arrow, ship

SHARD_ROWS, BLOCK_ROWS = 4096, 1 << 16
M, EF_BUILD, EF = 16, 64, 128


def usable(v: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)


def _diverse(cand: np.ndarray, near: np.ndarray, x: np.ndarray, most: int) -> list[int]:
    """Of candidates by ascending squared distance ``near`` the first ``most`` that are nearer to the
    base than to any taken before; then the nearest of the rest."""
    gap = ((x[cand][:, None, :] - x[cand][None, :, :]) ** 2).sum(2)
    free, taken = np.ones(len(cand), bool), []
    for i in range(len(cand)):
        if free[i]:
            taken.append(i)
            if len(taken) == most:
                break
            free &= gap[i] > near
            free[i] = False
    if len(taken) < most // 2:
        taken += [i for i in range(len(cand)) if i not in set(taken)][:most // 2 - len(taken)]
    return [int(cand[i]) for i in taken]


def build(x: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level (members, neighbours): members ascending, neighbours rows of member positions in ``x``, -1 padded."""
    n = len(x)
    rng = np.random.Generator(np.random.PCG64(seed))
    level = np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(int), 8)
    square = (x * x).sum(1)
    levels = []
    for at in range(int(level.max()) + 1):
        member = np.flatnonzero(level >= at)
        most, y, sq = 2 * m if at == 0 else m, x[member], square[member]
        links: list[list[int]] = [[] for _ in member]
        for lo in range(0, len(member), 512):
            hi = min(lo + 512, len(member))
            dist = sq[lo:hi, None] + sq[None, :hi] - 2 * (y[lo:hi] @ y[:hi].T)
            dist[np.arange(hi)[None, :] >= np.arange(lo, hi)[:, None]] = np.inf  # only those inserted before
            k = min(ef, hi)
            part = np.argpartition(dist, k - 1, axis=1)[:, :k] if k < hi else np.tile(np.arange(hi), (hi - lo, 1))
            for i in range(lo, hi):
                cand = part[i - lo]
                near = dist[i - lo, cand]
                order = np.argsort(near, kind="stable")[:min(len(cand), i)]
                if not len(order):
                    continue
                links[i] = _diverse(cand[order], near[order], y, m)
                for j in links[i]:
                    links[j].append(i)
                    if len(links[j]) > most:
                        other = np.array(links[j])
                        far = ((y[other] - y[j]) ** 2).sum(1)
                        order = np.argsort(far, kind="stable")
                        links[j] = _diverse(other[order], far[order], y, most)
        flat = np.full((len(member), most), -1, np.int32)
        for i, near_by in enumerate(links):
            flat[i, :len(near_by)] = member[near_by[:most]]
        levels.append((member.astype(np.int32), flat))
    return levels


def search(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, ef: int) -> np.ndarray:
    """Positions of about the ``ef`` nearest vectors to ``q``."""
    best = int(levels[-1][0][0])
    low = float(((x[best] - q) ** 2).sum())
    for member, flat in reversed(levels[1:]):
        while True:
            near = flat[np.searchsorted(member, best)]
            near = near[near >= 0]
            if not len(near):
                break
            d = ((x[near] - q) ** 2).sum(1)
            i = int(d.argmin())
            if d[i] >= low:
                break
            best, low = int(near[i]), float(d[i])
    flat = levels[0][1]
    seen = np.zeros(len(x), bool)
    seen[best] = True
    todo, found = [(low, best)], [(-low, best)]
    while todo:
        d, i = heapq.heappop(todo)
        if d > -found[0][0] and len(found) >= ef:
            break
        near = flat[i]
        near = near[near >= 0]
        near = near[~seen[near]]
        if not len(near):
            continue
        seen[near] = True
        dist = ((x[near] - q) ** 2).sum(1)
        bound = -found[0][0] if len(found) >= ef else np.inf
        for dj, j in zip(dist.tolist(), near.tolist(), strict=True):
            if dj < bound or len(found) < ef:
                heapq.heappush(todo, (dj, j))
                heapq.heappush(found, (-dj, j))
                if len(found) > ef:
                    heapq.heappop(found)
                    bound = -found[0][0]
    return np.array([j for _, j in found])


@dataclass(frozen=True)
class Frame:
    """Maps vectors to about [-1, 1]: divide by ``scale``, take off ``centre``, divide by ``spread``. Two steps, so that no
    step overflows or loses what an offset common to all vectors hides."""

    scale: float
    centre: np.ndarray
    spread: float

    @classmethod
    def of(cls, x: np.ndarray) -> Frame:
        scale = float(np.abs(x).max()) or 1.0
        y = x / scale
        centre = y.mean(0)
        return cls(scale, centre, float(np.abs(y - centre).max()) or 1.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        # a query may lie far outside its shard's range; its squares must stay finite
        with np.errstate(over="ignore"):
            return np.clip((x / self.scale - self.centre) / self.spread, -1e120, 1e120)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` to ``q``; rescaled where plain squares would leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        gap = x - q
        plain = np.sqrt((gap ** 2).sum(1))
        most = np.abs(gap).max(1)
        odd = ~np.isfinite(plain) | ((plain < 1e-140) & (most > 0))
        if odd.any():
            # halves, as a difference of two finite numbers may itself be out of range
            half = x[odd] / 2 - q / 2
            most = np.maximum(np.abs(half).max(1), math.ulp(0.0))
            plain[odd] = most * np.sqrt(((half / most[:, None]) ** 2).sum(1)) * 2
    return plain


_INDEX = "shard bigint, dim int, n int, vectors binary, ids array<array<bigint>>, members array<binary>, flats array<binary>"


def _build(pdf):
    """One shard of (shard, dim, vector, ids) to its row of ``_INDEX``."""
    import pandas as pd

    pdf = pdf.iloc[np.argsort(pdf["place"].to_numpy(), kind="stable")]
    x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
    levels = build(Frame.of(x)(x))
    return pd.DataFrame([{
        "shard": int(pdf["shard"].iloc[0]), "dim": x.shape[1], "n": len(x), "vectors": x.tobytes(),
        "ids": [list(map(int, v)) for v in pdf["ids"]], "members": [a.tobytes() for a, _ in levels], "flats": [b.tobytes() for _, b in levels]}])


def _search(k: int, ef: int):
    """Sorted rows, a shard's index row before its queries, to (query_id, mark, vec_id, score)."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = frame = exact = x = levels = ids = None
        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            out: list[tuple[int, int, int, float]] = []
            for r, at_shard in enumerate(column["shard"].to_pylist()):
                if column["vectors"][r].is_valid:
                    shard, n, dim = at_shard, column["n"][r].as_py(), column["dim"][r].as_py()
                    exact = np.frombuffer(column["vectors"][r].as_buffer(), np.float64).reshape(n, dim).copy()
                    frame = Frame.of(exact)
                    x = frame(exact)
                    members = [np.frombuffer(b.as_buffer(), np.int32).copy() for b in column["members"][r].values]
                    levels = [(a, np.frombuffer(b.as_buffer(), np.int32).reshape(len(a), -1).copy())
                              for a, b in zip(members, column["flats"][r].values, strict=True)]
                    ids = column["ids"][r].as_py()
                elif at_shard == shard:
                    me, mark = column["vec_id"][r].as_py(), column["mark"][r].as_py()
                    v = column["vector"][r].values.to_numpy(zero_copy_only=False).astype(np.float64)
                    at = search(x, levels, frame(v), max(ef, 2 * k))
                    score = distances(exact[at], v)
                    best = sorted(((float(s), i) for s, p in zip(score, at, strict=True) for i in ids[p] if i != me))[:k]
                    out += [(me, mark, i, s) for s, i in best]
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.float64())],
                names=["query_id", "mark", "vec_id", "score"])
    return find


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, ef: int = EF, shard_rows: int = SHARD_ROWS,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``vectors`` (vec_id, embedding) to each row of
    ``queries`` (the same columns) by Euclidean distance, without the query's own id."""
    clean = lambda df: df.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct()
    ship(vectors.sparkSession)
    with Scratch(vectors.sparkSession) as s:
        # the k + 1 smallest ids of each different vector
        nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
        nodes = s.table(clean(vectors).withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("vector").agg(
            F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumns(
            {"dim": F.size("vector"), "place": F.xxhash64("vector")}))
        sizes = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards")).withColumnRenamed("dim", "d")
        sizes = s.table(sizes)
        # shards of one dimension are numbered from 0; a shard is known by dim and number together
        dealt = nodes.join(sizes, nodes["dim"] == sizes["d"]).withColumn(
            "shard", F.col("dim") * F.lit(1 << 32) + F.pmod(F.xxhash64(F.col("place")), F.col("shards")))
        n_shards = sizes.agg(F.sum("shards")).first()[0] or 0
        index = s.table(dealt.select("shard", "place", "vector", "ids").repartition(max(n_shards, 1), "shard").groupBy(
            "shard").applyInPandas(_build, _INDEX))
        asked = clean(queries).select("vec_id", F.xxhash64("vector").alias("mark"), "vector", F.size("vector").alias("dim"))
        sent = asked.join(sizes, asked["dim"] == sizes["d"]).select(
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("number"), "dim", "vec_id", "mark", "vector").select(
            (F.col("dim") * F.lit(1 << 32) + F.col("number")).alias("shard"), "vec_id", "mark", "vector")
        # one stream for a shard and a block of queries: the graph, then the queries
        n_blocks = -(-asked.count() // block_rows) or 1
        sent = sent.withColumns({"block": F.pmod(F.xxhash64("vec_id", "mark"), F.lit(n_blocks)), "after": F.lit(1)})
        graphs = index.withColumns({"block": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))), "after": F.lit(0)})
        stream = graphs.unionByName(sent, allowMissingColumns=True).repartition(max(n_shards * n_blocks, 1), "shard", "block")
        stream = stream.sortWithinPartitions("shard", "block", "after").drop("block", "after")
        hits = s.table(map_arrow(stream, _search(k, ef), "query_id bigint, mark bigint, vec_id bigint, score double"), keep=True)
    best = Window.partitionBy("query_id", "mark").orderBy("score", "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
