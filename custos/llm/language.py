"""Language identification of words in code-switched text by a linear-chain CRF.

Each word is a position of a chain, each language a label. The emission score
of a word sums learned weights of hashed features: its prefixes and suffixes of
one to three bytes, the three-byte n-grams of the word between marks, and the
whole word (lexicon). Transitions between the languages of neighbouring words
are learned too. Forward-backward gives each word's probability of each
language. Words without a letter pass labels on but do not vote; a document's
language is the one with the most expected words, its score their share.

Training: all words of a labelled text carry its label; texts of different
languages are dealt into chains piece by piece, so that chains switch language
and transitions are learned from switches. Maximum likelihood by Adam over the
whole sample. At most ``max_docs`` texts of each label (those of the least hash of
doc_id) go to the driver; the model is a table of weights, sent with the task.

Chains are cut into stretches of ``STRETCH`` words, which run side by side: the
product of a stretch's matrices carries messages over it, and messages between
stretches follow document by document. That is the exact algorithm.

Rows: null, empty or letterless texts are ``und`` with score 0 and no runs; without
labelled texts every text is ``und``; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custos.llm import words as W
from custos.llm.quality import held_out
from custos.llm.scratch import map_arrow, text_mark

MAX_DOCS = 200
STRETCH = 32
BITS = 16
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def _fold(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte Latin capitals U+00C0 to U+00DE."""
    out = W._LOWER[data]
    out[1:] += (0x20 * ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))).astype(np.uint8)
    return out


@dataclass
class Kinds:
    """The different words of a chunk: which one each word is, and their features."""

    which: np.ndarray    # of each word
    letter: np.ndarray   # of each different word: does it hold a letter
    owner: np.ndarray    # of each feature: the different word it belongs to, ascending
    bucket: np.ndarray   # of each feature


def kinds(w: W.Words) -> Kinds:
    data = _fold(w.data)
    bytes_ = W.prefix(W._TABLE[data], W._P)
    whole = W.runs(bytes_, w.start, w.end, W._P)
    _, one, which = np.unique(whole, return_index=True, return_inverse=True)
    start, end, n = w.start[one], w.end[one], len(one)
    letters = np.concatenate(([0], np.cumsum(_LETTER[w.data])))
    parts, owners = [whole[one]], [np.arange(n)]
    for k in (1, 2, 3):
        long = np.flatnonzero(end - start >= k)
        s, e = start[long], end[long]
        parts += [W.runs(bytes_, s, s + k, W._P) + W.U(k), W.runs(bytes_, e - k, e, W._P) + W.U(16 + k)]
        owners += [long, long]
    count = np.maximum(end - start - 2, 0)
    owner = np.repeat(np.arange(n), count)
    at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    parts.append(W.runs(bytes_, at, at + 3, W._P) + W.U(64))
    owners.append(owner)
    owner, bucket = np.concatenate(owners), (W.mix(np.concatenate(parts)) & W.U((1 << BITS) - 1)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return Kinds(which, letters[end] > letters[start], owner[order], bucket[order])


def emissions(k: Kinds, weights: np.ndarray) -> np.ndarray:
    """Score of each label for each different word; 0 for words without a letter."""
    n = len(k.letter)
    if not n:
        return np.zeros((0, weights.shape[1]))
    first = np.searchsorted(k.owner, np.arange(n))
    return np.add.reduceat(weights[k.bucket], first, axis=0) * k.letter[:, None]


def marginals(score: np.ndarray, bounds: np.ndarray, transition: np.ndarray,
              joint: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over chains bounds[i]:bounds[i+1] of rows of ``score``: each position's
    label probabilities, the expected transitions (if ``joint``), and the log partition sum."""
    n, labels = score.shape
    step = np.exp(transition - transition.max())
    top = score.max(1, keepdims=True) if n else np.zeros((0, 1))
    out = np.exp(score - top)
    length = np.diff(bounds)
    pieces = -(-length // STRETCH)
    total = int(pieces.sum())
    if not total:
        return np.zeros((0, labels)), np.zeros((labels, labels)), 0.0
    chain = np.repeat(np.arange(len(length)), pieces)
    nth = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = bounds[:-1][chain] + nth * STRETCH
    size = np.minimum(bounds[1:][chain] - first, STRETCH)
    index = np.minimum(first[:, None] + np.arange(STRETCH), n - 1)
    grid = np.where((np.arange(STRETCH) < size[:, None])[:, :, None], out[index], 0)
    # the matrix of each stretch
    product = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for t in range(STRETCH):
        live = np.flatnonzero(size > t)
        x = (product[live] @ step) * grid[live, t][:, None, :]
        product[live] = x / x.max((1, 2), keepdims=True)
    # messages between stretches, all chains side by side
    into, back = np.full((total, labels), 1.0 / labels), np.ones((total, labels))
    lead = np.cumsum(pieces) - pieces
    for j in range(1, int(pieces.max())):
        has = np.flatnonzero(pieces > j)
        at = lead[has] + j
        x = np.einsum("ni,nij->nj", into[at - 1], product[at - 1])
        into[at] = x / x.sum(1, keepdims=True)
        at = lead[has] + pieces[has] - 1 - j
        x = np.einsum("nij,nj->ni", product[at + 1], back[at + 1])
        back[at] = x / x.sum(1, keepdims=True)
    ahead, behind = np.empty((total, STRETCH, labels)), np.empty((total, STRETCH, labels))
    log_z, now = 0.0, into
    for t in range(STRETCH):
        x = (now @ step) * grid[:, t]
        s = x.sum(1)
        live = size > t
        log_z += float(np.log(s[live]).sum())
        now = np.where(live[:, None], x / np.where(live, s, 1)[:, None], now)
        ahead[:, t] = now
    now = back
    for t in range(STRETCH - 1, -1, -1):
        behind[:, t] = now
        x = (now * grid[:, t]) @ step.T
        s = x.sum(1, keepdims=True)
        now = np.where((size > t)[:, None], x / np.where(s > 0, s, 1), now)
    valid = np.arange(STRETCH) < size[:, None]
    p = (ahead * behind)[valid]
    p /= p.sum(1, keepdims=True)
    log_z += float(top.sum()) + float(transition.max()) * n
    if not joint:
        return p, np.zeros((labels, labels)), log_z
    # expected transitions into each position but a chain's first
    before = np.concatenate([into[:, None], ahead[:, :-1]], axis=1)[valid]
    both = before[:, :, None] * step * (out * behind[valid])[:, None, :]
    both /= both.sum((1, 2), keepdims=True)
    inner = np.ones(n, bool)
    inner[bounds[:-1][length > 0]] = False
    return p, both[inner].sum(0), log_z


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray     # float32, 2**BITS by labels
    transition: np.ndarray


def fit(texts: list[str], labels: list[str], steps: int = 40, rate: float = 0.15, ridge: float = 1e-3,
        piece: int = 24, chain: int = 20) -> Model:
    """Maximum likelihood on chains of ``chain`` pieces of up to ``piece`` words of any of the texts."""
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)))
    rng = np.random.Generator(np.random.PCG64(3))
    parts: list[tuple[bytes, int]] = []
    for text, label in zip(texts, labels, strict=True):
        w = text.encode().split()
        parts += [(b" ".join(w[i:i + piece]), names.index(label)) for i in range(0, len(w), piece)]
    order = rng.permutation(len(parts))
    joined = [b" ".join(parts[i][0] for i in order[j:j + chain]).decode() for j in range(0, len(order), chain)]
    gold = np.concatenate([np.full(parts[i][0].count(b" ") + 1, parts[i][1]) for i in order]) if parts else np.zeros(0, int)
    chunks, done = [], 0
    for w in W.words(pa.array(joined, pa.string())):
        n = len(w.hash)
        chunks.append((kinds(w), w.bounds, gold[done:done + n]))
        done += n
    size = len(names)
    theta = [np.zeros((1 << BITS, size)), np.zeros((size, size))]
    mean, var = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    total = max(done, 1)
    for it in range(1, steps + 1):
        grad = [ridge * x for x in theta]
        for k, bounds, y in chunks:
            p, joint, _ = marginals(emissions(k, theta[0])[k.which], bounds, theta[1])
            p[np.arange(len(y)), y] -= 1
            each = np.stack([np.bincount(k.which, p[:, c], len(k.letter)) for c in range(size)], 1) * k.letter[:, None]
            for c in range(size):
                grad[0][:, c] += np.bincount(k.bucket, each[k.owner, c], 1 << BITS) / total
            inner = np.ones(len(y), bool)
            inner[bounds[:-1][np.diff(bounds) > 0]] = False
            at = np.flatnonzero(inner)
            np.add.at(joint, (y[at - 1], y[at]), -1)
            grad[1] += joint / total
        for x, g, m, v in zip(theta, grad, mean, var, strict=True):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            x -= rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.98**it)) + 1e-8)
    return Model(names, theta[0].astype(np.float32), theta[1])


def _label(model: Model):
    """Arrow batches of (text, ...) to expected words of each label, voting words and runs of labels."""
    size = len(model.labels)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mass, voting, firsts, lasts, langs, edge = [], [], [], [], [], [np.zeros(1, np.int64)]
            for w in W.words(batch.column(0)):
                k = kinds(w)
                p, _, _ = marginals(emissions(k, model.weights)[k.which].astype(float), w.bounds, model.transition, joint=False)
                vote = k.letter[k.which]
                doc = w.doc
                mass.append(np.stack([np.bincount(doc[vote], p[vote, c], w.n_docs) for c in range(size)], 1))
                voting.append(np.bincount(doc[vote], minlength=w.n_docs))
                best = p.argmax(1)
                new = np.ones(len(best), bool)
                new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
                lead = np.flatnonzero(new)
                row = doc[lead]
                base = w.bounds[row]
                firsts.append(lead - base)
                lasts.append(np.append(lead[1:], len(best))[:len(lead)] - base)
                langs.append(best[lead])
                edge.append(edge[-1][-1] + np.searchsorted(row, np.arange(1, w.n_docs + 1)))
            cat = lambda x, kind=np.int32: pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind))
            m = np.concatenate(mass) if mass else np.zeros((0, size))
            names = pa.array(model.labels, pa.string())
            runs = pa.StructArray.from_arrays([cat(firsts), cat(lasts), names.take(cat(langs))], ["first", "last", "lang"])
            best = m.argmax(1)
            n = np.concatenate(voting) if voting else np.zeros(0)
            yield pa.RecordBatch.from_arrays([
                names.take(pa.array(best)), pa.array(m[np.arange(len(best)), best] / np.maximum(n, 1)),
                pa.ListArray.from_arrays(cat(edge), runs), *batch.columns[1:],
            ], names=["lang_pred", "score", "runs", *batch.schema.names[1:]])
    return label


def learn(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Fit on texts of ``docs`` (doc_id, text, lang) that have a lang and aren't held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                       & ~held_out(F.col("doc_id"))).select("lang", "text", "doc_id")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", text_mark()))
    rows = known.withColumn("nth", nth).where(F.col("nth") <= max_docs).select("text", "lang").collect()
    return fit([r[0] for r in rows], [r[1] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, runs) of every row of ``docs`` (doc_id, text): the language of
    the whole text, and the runs of words [first, last) of one language, word by word the likeliest."""
    no_runs = F.array().cast("array<struct<first:int,last:int,lang:string>>")
    if not model.labels:
        return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"),
                           F.lit(0.0).alias("score"), no_runs.alias("runs"))
    letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    rows = map_arrow(docs.select("text", "doc_id", letter.alias("letter")), _label(model),
                     "lang_pred string, score double, runs array<struct<first:int,last:int,lang:string>>, doc_id bigint, letter boolean")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                       F.when(F.col("letter"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
                       F.when(F.col("letter"), F.least("score", F.lit(1.0))).otherwise(0.0).alias("score"),
                       F.when(F.col("letter"), F.col("runs")).otherwise(no_runs).alias("runs"))
