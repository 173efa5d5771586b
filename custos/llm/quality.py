"""Quality classifier: Bradley-Terry scores learned from preference pairs.

Each document has a few figures of its whole text (below). A preference pair is a
document of label 1 and one of label 0; the probability that the first is
preferred is the logistic of the difference of their scores, and a score is linear in
the figures, so the logistic loss on figure differences gives the weights (Newton
steps, ridge penalty). The threshold is a quantile of the scores of all labelled rows: the
share of label 0 among them. A document's ``score`` is a logistic of its distance from this
threshold, which lies at 0.3, with the steepness of highest likelihood, again over all of them.

Figures are computed once for all documents in one pass over the texts, with numpy per Arrow
batch; scoring is a column expression. The weights are fitted on at most ``max_rows`` labelled rows of each
label (those of the least hash of doc_id) on the driver: 2 * 10,000 rows of figures, whatever the input. If
a label has more rows, threshold and steepness are found on Spark over all rows of both (``calibrate``).

Rows: null and empty texts have all figures 0 and are scored like any other; rows whose label or doc_id is
null are not learned from; a doc_id labelled twice counts twice; without labels of both kinds every
score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custos.llm import words as W
from custos.llm.scratch import Scratch, map_arrow, packed_rest

MAX_ROWS = 10_000
PAIRS_EACH = 4
THRESHOLD = 0.3
SHORT = 4  # added to the words (or bytes) a share is of, so that a few words are little evidence
FIGURES = ("log_words", "upper", "symbols", "symbol_words", "bare_words", "again", "repeated")

_KIND = np.zeros(256, np.uint8)  # 1 upper case, 2 lower case or not ASCII, 3 digit, 4 symbol
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x80:], _KIND[0x30:0x3A] = 1, 2, 2, 3
_KIND[list(b"!#$%&*<>[\\]^`{|}~")] = 4


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many different values each document has."""
    if not len(value):
        return np.zeros(n, np.int64)
    edge = np.searchsorted(doc, np.arange(n + 1))
    out = np.zeros(n, np.int64)
    for i in np.flatnonzero(np.diff(edge)):
        x = np.sort(value[edge[i]:edge[i + 1]])
        out[i] = 1 + np.count_nonzero(x[1:] != x[:-1])
    return out


def figures(column: pa.Array) -> np.ndarray:
    """One row of ``FIGURES`` per text."""
    parts = []
    for w in W.words(column):
        n, doc, count = w.n_docs, w.doc, np.diff(w.bounds)
        kind = _KIND[w.data]
        tally = [np.concatenate(([0], np.cumsum(kind == k))) for k in range(5)]
        of = lambda k, a, b: tally[k][b] - tally[k][a]  # noqa: B023,E731
        per_doc = [of(k, w.offsets[:-1], w.offsets[1:]) for k in range(5)]
        letters = per_doc[1] + per_doc[2]
        bytes_ = np.diff(w.offsets)
        share = lambda a, b: a / (b + SHORT)
        words_with = lambda mask: np.bincount(doc[mask], minlength=n)[:n]  # noqa: B023,E731
        symbol = of(4, w.start, w.end) > 0
        bare = of(1, w.start, w.end) + of(2, w.start, w.end) + of(3, w.start, w.end) == 0
        same = np.zeros(len(doc), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
        parts.append(np.stack([
            np.log1p(count), share(per_doc[1], letters), share(per_doc[4], bytes_), share(words_with(symbol), count),
            share(words_with(bare), count), share(words_with(same), count),
            share(count - _distinct(doc, w.hash, n), count)], axis=1))
    return np.concatenate(parts) if parts else np.zeros((0, len(FIGURES)))


def _figure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = figures(batch.column(0))
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([rows, *batch.columns[1:]], names=["figures", *batch.schema.names[1:]])


@dataclass
class Model:
    weights: list[float]
    threshold: float
    steepness: float
    constant: float | None = None  # the score of every document if nothing could be learned

    def margin(self, x: Column) -> Column:
        """The score before threshold and steepness."""
        return sum((F.lit(w) * x[i] for i, w in enumerate(self.weights)), F.lit(0.0))

    def score(self, x: Column) -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        z = (self.margin(x) - self.threshold) * self.steepness + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + F.exp(-z))


def fit(good: np.ndarray, bad: np.ndarray, ridge: float = 1e-2) -> Model:
    """Bradley-Terry weights from every ``bad`` row against some ``good`` rows and the reverse."""
    if not len(good) or not len(bad):
        return Model([], 0.0, 0.0, len(good) / (len(good) + len(bad)) if len(good) + len(bad) else 0.5)
    both = np.concatenate([good, bad])
    scale = np.maximum(both.std(0), 1e-6)
    a = np.arange(max(len(good), len(bad)) * PAIRS_EACH)
    # steps prime to the lengths deal the pairs out evenly
    diff = (good[(a * 7919) % len(good)] - bad[(a * 104729) % len(bad)]) / scale
    w = np.zeros(diff.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = diff.T @ (p - 1) / len(diff) + ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    w /= scale
    up, down = good @ w, bad @ w
    threshold = float(np.quantile(np.concatenate([up, down]), len(down) / len(both), method="midpoint"))
    offset, k = math.log(THRESHOLD / (1 - THRESHOLD)), 1.0
    m, y = np.concatenate([up, down]) - threshold, np.repeat([1.0, 0.0], [len(up), len(down)])
    for _ in range(50):  # likelihood of the steepness alone
        p = 1 / (1 + np.exp(-np.clip(k * m + offset, -30, 30)))
        step = (m @ (p - y) + 1e-2 * k) / ((m * m) @ (p * (1 - p)) + 1e-2)
        k = float(np.clip(k - np.clip(step, -1, 1), 0.05, 20))
    return Model([float(v) for v in w], threshold, k)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def nth(values: DataFrame, n: int, few: int = 10_000, buckets: int = 4096) -> float:
    """The ``n``-th smallest (from 0) of the one column ``m``, exactly: each round counts equal ranges of
    values and keeps the one with the rank, until few rows or one value are left."""
    while True:
        lo, hi, rows = values.agg(F.min("m"), F.max("m"), F.count(F.lit(1))).first()
        if lo == hi:
            return lo
        if rows <= few:
            return sorted(r[0] for r in values.select("m").collect())[n]
        at = F.least(F.floor((F.col("m") - lo) / (hi - lo) * buckets), F.lit(buckets - 1))
        for _, size, least, most in sorted(values.groupBy(at.alias("at")).agg(F.count(F.lit(1)), F.min("m"), F.max("m")).collect()):
            if n < size:
                break
            n -= size
        values = values.where(F.col("m").between(least, most))


def calibrate(model: Model, marked: DataFrame, n_bad: int) -> Model:
    """``model`` with threshold and steepness of highest likelihood over all rows of ``marked`` (figures, quality)."""
    with Scratch(marked.sparkSession) as s:
        rows = s.table(marked.select(model.margin(F.col("figures")).alias("m"), F.col("quality").cast("double").alias("y")))
        # as many rows below the threshold as label 0 has
        last = nth(rows.select("m"), n_bad - 1)
        upto, after = rows.agg(F.count_if(F.col("m") <= last), F.min(F.when(F.col("m") > last, F.col("m")))).first()
        threshold = last if upto > n_bad else (last + after) / 2
        offset, k, m = math.log(THRESHOLD / (1 - THRESHOLD)), model.steepness, F.col("m") - threshold
        exact = lambda x: F.sum(x.cast("decimal(28,16)")).cast("double")  # noqa: E731  the same in any order of rows
        for _ in range(50):
            p = 1 / (1 + F.exp(-F.least(F.greatest(m * k + offset, F.lit(-30.0)), F.lit(30.0))))
            slope, bend = rows.agg(exact(m * (p - F.col("y"))), exact(m * m * p * (1 - p))).first()
            was, k = k, float(np.clip(k - np.clip((slope + 1e-2 * k) / (bend + 1e-2), -1, 1), 0.05, 20))
            if abs(k - was) < 1e-9:
                break
    return Model(model.weights, threshold, k)


def learn(known: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on rows of ``known`` (doc_id, figures) that ``labels`` (doc_id, quality) marks and that aren't held out."""
    marked = known.where(~held_out(F.col("doc_id"))).join(
        labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality"), "doc_id")
    with Scratch(known.sparkSession) as s:
        marked = s.table(marked)
        count = {r[0]: r[1] for r in marked.groupBy("quality").count().collect()}
        sample = [np.array([r[0] for r in marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id")
                            .limit(max_rows).select("figures").collect()]).reshape(-1, len(FIGURES)) for q in (1, 0)]
        model = fit(*sample)
        whole = model.constant is not None or max(count.values()) <= max_rows
        return model if whole else calibrate(model, marked, count[0])


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    known = map_arrow(docs.select("text", "doc_id"), _figure_rows, "figures array<double>, doc_id bigint")
    with Scratch(docs.sparkSession) as s:
        known = s.table(known, keep=True)
    out = known.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                       learn(known, labels, max_rows).score(F.col("figures")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` at or above the threshold, unchanged."""
    one = docs.select("text", packed_rest(docs, docs.columns).alias("row"))
    known = map_arrow(docs.select("text", "doc_id"), _figure_rows, "figures array<double>, doc_id bigint")
    with Scratch(docs.sparkSession) as s:
        model = learn(s.table(known), labels, max_rows)
    rows = map_arrow(one, _figure_rows, "figures array<double>", "row")
    return rows.where(model.score(F.col("figures")) >= THRESHOLD).select("row.*")
