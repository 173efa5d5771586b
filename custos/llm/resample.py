"""Importance resampling towards a target: array-scored weights, then a distributed quickselect.

Hashed runs of words are counted in the corpus and in the target texts; the log ratio of their shares in each bucket
is the bucket's *gain*, one dense array. A document's weight is the sum of the gains of its features, looked up for
whole Arrow columns at once. Added Gumbel noise (from a seeded hash of the id) makes the highest scores a draw
without replacement in proportion to the weights' exponentials.

The draw needs the k-th best of all (score, doc_id) keys, not their order: each round takes random pivot keys from
the rows still open, counts the rows below, at and between all pivots in one pass (three-way partition), and goes on in
the one gap that holds rank k, until the k-th key is itself a pivot. Only rows up to that key are sorted and numbered.
What comes to the driver: ``buckets`` counts, at most ``PIVOTS`` keys and twice as many counts a round, and one
count for each partition of the winners.

Words: A-Z lower-cased, maximal runs of 0-9, a-z and non-ASCII characters; a null text has none. A feature is a run of
1 to ``ngrams`` words joined by one space, its bucket the crc32 of its UTF-8 bytes modulo ``buckets``.

Rows: every row is scored, repeated ones too; texts of fewer than ``least_words`` words are never drawn. Ties in score go
to the smaller doc_id (none comes last, and is hashed as the empty text), then to the smaller hash of the text; of rows
equal in all of it any are drawn, as many as there is room for. An empty target, or corpus, gives gains by the same formula.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custos.llm import words as W
from custos.llm.scratch import Scratch, fresh, map_arrow, packed_rest

BUCKETS = 10_000
PIVOTS = 31
LONG_WORD = 64  # bytes; longer words are hashed one by one
_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _crc_table() -> np.ndarray:
    """The register after each byte value, by eight steps of the reflected polynomial."""
    reg = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        reg = np.where(reg & 1, (reg >> 1) ^ np.uint32(0xEDB88320), reg >> 1)
    return reg


_CRC = _crc_table()


def feed(reg: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The crc registers ``reg`` after the bytes [start, end) of ``data``, all words side by side, byte by byte."""
    size = end - start
    out = reg.copy()
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = zlib.crc32(data[start[i]:end[i]], int(~reg[i])) ^ 0xFFFFFFFF
    short = np.flatnonzero(size <= LONG_WORD)
    short = short[np.argsort(-size[short], kind="stable")]  # longest first: those still running are a prefix
    run, at, less = reg[short], start[short], -size[short]
    for k in range(int(-less[0]) if len(less) else 0):
        m = int(np.searchsorted(less, -k))
        run[:m] = _CRC[(run[:m] ^ data[at[:m] + k]) & 255] ^ (run[:m] >> 8)
    out[short] = run
    return out


def _features(column: pa.Array, ngrams: int, buckets: int) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For chunks of whole rows: words of each row, and for each run length the buckets in order with the rows' bounds."""
    raw, off = W.text_buffers(column)
    for i, j in W.spans(off):
        data, edge = _LOWER[raw[off[i]:off[j]]], off[i:j + 1] - off[i]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _INSIDE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[edge] = True
        start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        bounds = np.searchsorted(start, edge)
        row = np.repeat(np.arange(j - i), np.diff(bounds))
        first, reg, out = np.arange(len(start)), np.full(len(start), 0xFFFFFFFF, np.uint32), []
        for n in range(ngrams):
            fits = first + n < bounds[1:][row[first]]
            first, reg = first[fits], reg[fits]
            if n:
                reg = _CRC[(reg ^ 0x20) & 255] ^ (reg >> 8)
            reg = feed(reg, data, start[first + n], end[first + n])
            out.append(((~reg).astype(np.int64) % buckets, np.searchsorted(first, bounds)))
        yield np.diff(bounds), out


def _count(ngrams: int, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that the task met."""
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for _, runs in _features(batch.column(0), ngrams, buckets):
            for at, _ in runs:
                total += np.bincount(at, minlength=buckets)
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], names=["bucket", "n"])


def _weigh(ngrams: int, gains: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, features, weight = [], [], []
        for count, runs in _features(batch.column(0), ngrams, len(gains)):
            n, w = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
            for at, bounds in runs:
                sums = np.concatenate(([0], np.cumsum(gains[at])))
                n += np.diff(bounds)
                w += sums[bounds[1:]] - sums[bounds[:-1]]
            words.append(count)
            features.append(n)
            weight.append(w)
        made = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (words, features, weight)]
        yield pa.RecordBatch.from_arrays([*made, *batch.columns[1:]], names=["n_words", "n_features", "weight", *batch.schema.names[1:]])


def bucket_counts(texts: DataFrame, ngrams: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; buckets without any are absent."""
    rows = map_arrow(texts.select("text"), partial(_count, ngrams, buckets), "bucket bigint, n bigint")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, ngrams: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln of the target's share over the corpus's share), each bucket's count raised by one."""
    s, t = (np.zeros(buckets), np.zeros(buckets))
    for have, texts in ((s, docs), (t, target)):
        for bucket, n in bucket_counts(texts, ngrams, buckets).collect():
            have[bucket] = n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(doc_id: Column, seed: str) -> Column:
    """floor(-1000 * ln(-ln(u))) with u in (0, 1) from the first 32 bits of sha256(``seed:doc_id``)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


@dataclass(frozen=True)
class Key:
    """A place in the order: bigint columns compared one after the other, smaller first. Conditions are SQL texts: a
    round's tree of them is parsed at once, where as many Column calls would take seconds."""

    columns: tuple[str, ...]

    def less(self, value: tuple) -> str:
        """Rows whose key is before ``value``."""
        out = "false"
        for c, v in reversed(list(zip(self.columns, value, strict=True))):
            out = f"({c} < {v}L or ({c} = {v}L and {out}))"
        return out

    def equal(self, value: tuple) -> str:
        return "(" + " and ".join(f"{c} = {v}L" for c, v in zip(self.columns, value, strict=True)) + ")"

    def place(self, pivots: list[tuple], lo: int = 0, hi: int | None = None) -> str:
        """2 * i + 1 for rows equal to pivot i of the sorted ``pivots``, 2 * i for those between pivots i - 1 and i:
        a binary search as nested conditions."""
        hi = len(pivots) if hi is None else hi
        if lo == hi:
            return str(2 * lo)
        mid = (lo + hi) // 2
        return (f"case when {self.less(pivots[mid])} then {self.place(pivots, lo, mid)} "
                f"when {self.equal(pivots[mid])} then {2 * mid + 1} else {self.place(pivots, mid + 1, hi)} end")


def kth(rows: DataFrame, key: Key, k: int, scratch: Scratch, pivots: int = PIVOTS, seed: int = 0) -> tuple:
    """The ``k``-th smallest key (from 1) of ``rows``, a table with at least ``k`` rows, none null.

    A round reads the open rows twice and leaves about two of ``pivots`` + 1 parts of them, written as the next round's table."""
    rows = rows.select(*key.columns)
    while True:
        seed += 1
        drawn = sorted({tuple(r) for r in rows.orderBy(F.rand(seed)).limit(pivots).collect()})
        count = dict(rows.groupBy(F.expr(key.place(drawn)).alias("place")).count().collect())
        for place in sorted(count):
            if k <= count[place]:
                break
            k -= count[place]
        if place % 2:
            return drawn[place // 2]
        i = place // 2
        after = f"not ({key.less(drawn[i - 1])} or {key.equal(drawn[i - 1])})" if i else "true"
        before = key.less(drawn[i]) if i < len(drawn) else "true"
        rows = scratch.table(rows.where(f"{after} and {before}"))


def numbered(rows: DataFrame, key: Key, name: str, scratch: Scratch) -> DataFrame:
    """``rows`` with their place (from 1) in the order of ``key``: a range sort, and an offset for each partition."""
    at, part, before = fresh(rows, "_at", "_part", "_before")
    sort = scratch.table(rows.orderBy(*key.columns).withColumn(at, F.monotonically_increasing_id()), keep=True)
    total, offsets = 0, []
    for p, n in sorted(sort.groupBy(F.shiftright(at, 33).alias(part)).count().collect()):
        offsets.append((p, total))
        total += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(offsets, f"`{part}` bigint, `{before}` bigint"))
    inner = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return sort.withColumn(part, F.shiftright(at, 33)).join(offsets, part).withColumn(
        name, F.col(before) + inner + 1).drop(at, part, before)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, ngrams: int = 1,
             buckets: int = BUCKETS, seed: str = "2024", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, unless named) of every row of ``docs`` (doc_id, text) with n_features, weight, score and
    rank: 1, 2, 3 ... for the floor(``percent`` * N / 100) best of the N texts with ``least_words`` words, else null."""
    keep = docs.columns if keep is None else keep
    gain = gains(docs, target, ngrams, buckets)
    one = docs.select("text", F.struct(packed_rest(docs, keep).alias("row"), F.col("doc_id").alias("id"),
                                       F.xxhash64("text").alias("mark")).alias("_passed"))
    weighed = map_arrow(one, partial(_weigh, ngrams, gain), "n_words bigint, n_features bigint, weight bigint", "_passed")
    score = (F.col("weight") + noise(F.col("_passed.id"), seed)).cast("bigint")
    scored = weighed.select(
        "_passed.row", "n_words", "n_features", "weight", score.alias("score"), (-score).alias("k0"),
        F.coalesce(F.col("_passed.id").cast("bigint"), F.lit((1 << 63) - 1)).alias("k1"), F.col("_passed.mark").alias("k2"))
    key, none = Key(("k0", "k1", "k2")), F.lit(None).cast("bigint")
    with Scratch(docs.sparkSession) as s:
        scored = s.table(scored, keep=True)
        able = scored.where(F.col("n_words") >= least_words)
        k = able.count() * percent // 100
        if k:
            last = kth(able, key, k, s)
            won = f"n_words >= {int(least_words)} and ({key.less(last)} or {key.equal(last)})"
            ranked = numbered(scored.where(won), key, "rank", s)
            ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
            out = scored.where(f"not ({won})").withColumn("rank", none).unionByName(ranked)
        else:
            out = scored.withColumn("rank", none)
    names = fresh(docs.select(*[F.lit(0).alias(c) for c in keep]), "n_features", "weight", "score", "rank")
    return out.select(*[F.col("row")[c].alias(c) for c in keep],
                      *[F.col(c).alias(name) for c, name in zip(("n_features", "weight", "score", "rank"), names, strict=True)])
