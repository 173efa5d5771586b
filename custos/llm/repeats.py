"""Substring deduplication by an anchored count of the windows of a corpus.

The corpus is its own reference. Its word sequence is cut into *reference
blocks* at places that depend on content alone: each window of ``window`` words
names the least of its ``seed``-word hashes as its anchor (leftmost if tied),
and a block is a maximal run of windows with one anchor. Equal windows have
equal anchors at equal places in them, wherever they lie, so a window can
only repeat inside blocks of the same anchor, and anchors are about one in
fifteen words. Blocks are indexed by (anchor, content hash).

The method asked for is a relative Lempel-Ziv parse; this replaces it. There is no
greedy parse: no match is extended from left to right and there are no factors. A block whose content is indexed
elsewhere is a duplicate span whole; of a block whose anchor is known but whose content isn't, every
window is hashed and counted within its anchor. A greedy parse copies each factor from
one place, so windows across its factor boundaries can repeat elsewhere unseen and must be looked up all the
same, document by document in order; the count needs no order and no random access to
the corpus. The result is exact: a word
is in a span if and only if a window over it also starts elsewhere (the same
document included). Identity is by 64-bit content hash within a 64-bit anchor.

Hot content: equal blocks of one document are one row with the word ranges that
they cover, so a few words over and over (every block the same) cost a row a
document, not one a block. These rows are counted with map-side aggregation, equal blocks are one
row of the index however often they occur, and joins have the documents' rows on
one side only and one row a key on the other, so that skewed keys split.

Rows: null texts have no words; documents that share a doc_id, or have none, are
told apart by their text; equal rows repeat each other; other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custos.llm import words as W
from custos.llm.scratch import Scratch, fresh, map_arrow, packed_rest, text_mark

WINDOW = 35
SEED = 6

_RANGES = pa.struct([("first", pa.int32()), ("last", pa.int32())])
_BLOCKS = ("doc_id bigint, mark bigint, anchor bigint, content bigint, windows int, times int, "
           "ranges array<struct<first: int, last: int>>")
_CHECKED = "doc_id bigint, mark bigint, anchor bigint, win bigint, first int, single boolean"


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _blocks(window: int, seed: int):
    """Arrow batches of (doc_id, mark, text) to rows of ``_BLOCKS``: one for all ``times`` that a block is in a
    document, with the ``ranges`` of words that these cover, in order and apart."""
    width = window - seed + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in W.words(batch.column("text")):
                n = len(w.hash)
                if n < window:
                    continue
                sums = w.sequence_sums()
                at = np.arange(n - seed + 1)
                grams = w.sequences(sums, at, at + seed)
                _, place = W.sliding_min(grams, width)
                doc = w.doc[:len(place)]
                inside = np.arange(len(place)) + window <= w.bounds[1:][doc]
                start = np.flatnonzero(inside)
                if not len(start):
                    continue
                place, doc = place[start], doc[start]
                new = np.ones(len(start), bool)
                new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
                lead = np.flatnonzero(new)
                count = np.diff(np.append(lead, len(start)))
                first, row = start[lead], doc[lead]
                last = first + count + window - 1
                content, anchor = w.sequences(sums, first, last), grams[place[lead]]
                order = np.lexsort((content, anchor, row))  # stable: equal blocks stay in the order of the text
                first, last, row, count, content, anchor = (x[order] for x in (first, last, row, count, content, anchor))
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
                each = np.flatnonzero(new)
                # equal blocks are equally long, so those that overlap or touch follow each other
                new[1:] |= first[1:] > last[:-1]
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(row)) - 1
                ranges = pa.StructArray.from_arrays(
                    [pa.array((x - w.bounds[row[begin]]).astype(np.int32)) for x in (first[begin], last[end])], fields=list(_RANGES))
                edge = pa.array(np.append(np.searchsorted(begin, each), len(begin)).astype(np.int32))
                rows = pa.array(row[each] + w.first)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(rows), batch.column("mark").take(rows),
                    _int64(anchor[each]), _int64(content[each]), pa.array(count[each].astype(np.int32)),
                    pa.array(np.diff(np.append(each, len(row))).astype(np.int32)), pa.ListArray.from_arrays(edge, ranges),
                ], names=["doc_id", "mark", "anchor", "content", "windows", "times", "ranges"])
    return cut


def _windows(window: int):
    """Arrow batches of (doc_id, mark, text, blocks) to one row of ``_CHECKED`` per window of the blocks."""
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("blocks")
            flat, edge = blocks.flatten(), np.concatenate(([0], np.cumsum(blocks.value_lengths().to_numpy(zero_copy_only=False))))
            for w in W.words(batch.column("text")):
                a, b = edge[w.first], edge[w.first + w.n_docs]
                part = flat.slice(a, b - a)
                count = part.field("windows").to_numpy().astype(np.int64)
                row = np.repeat(np.arange(w.n_docs), np.diff(edge[w.first:w.first + w.n_docs + 1]))
                which = np.repeat(np.arange(len(count)), count)
                step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                first = part.field("first").to_numpy()[which] + step
                at = first + w.bounds[row[which]]
                rows, which = pa.array(row[which] + w.first), pa.array(which)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(rows), batch.column("mark").take(rows),
                    part.field("anchor").take(which), _int64(w.sequences(w.sequence_sums(), at, at + window)),
                    pa.array(first.astype(np.int32)), part.field("single").take(which),
                ], names=["doc_id", "mark", "anchor", "win", "first", "single"])
    return expand


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, mark, spans): per document with repeats, the word ranges [first, last)
    covered by a window of ``window`` words that also starts elsewhere. Ranges may
    overlap. ``mark`` is ``text_mark`` of the row."""
    docs = docs.select("doc_id", text_mark().alias("mark"), "text").where("text is not null")
    key = ["doc_id", "mark"]
    with Scratch(docs.sparkSession) as s:
        blocks = s.table(map_arrow(docs, _blocks(window, seed), _BLOCKS))
        # anchors that occur again; if they have one content only, all their blocks are copies.
        # Counts are tables of their own, so that the joins with them can split a hot key
        known = s.table(blocks.groupBy("anchor").agg(
            F.sum("times").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi")
        ).where("n > 1").select("anchor", (F.col("lo") == F.col("hi")).alias("alike")))
        blocks = s.table(blocks.join(known, "anchor"))
        unlike = blocks.where("not alike")
        # the index of the other anchors: one row for each different block
        index = s.table(unlike.groupBy("anchor", "content").agg(
            F.sum("times").alias("copies"),
            F.min(F.struct("doc_id", "mark", F.col("ranges")[0]["first"].alias("first"), "windows")).alias("one")))
        copied = blocks.where("alike").drop("alike").unionByName(unlike.drop("alike").join(
            index.where("copies > 1").select("anchor", "content"), ["anchor", "content"]))
        ends = index.select("one.*", "anchor", (F.col("copies") == 1).alias("single"))
        ends = ends.groupBy("doc_id", "mark").agg(
            F.collect_list(F.struct("anchor", "first", "windows", "single")).alias("blocks"))
        ends = docs.join(ends, _same(docs, ends)).select(docs["doc_id"], docs["mark"], "text", "blocks")
        checked = s.table(map_arrow(ends, _windows(window), _CHECKED))
        met = s.table(checked.groupBy("anchor", "win").count().where("count > 1").select("anchor", "win"))
        found = checked.where("single").join(met, ["anchor", "win"])
        spans = copied.select(*key, "ranges").unionByName(
            found.select(*key, F.array(F.struct("first", (F.col("first") + window).alias("last"))).alias("ranges")))
        return s.table(spans.groupBy(*key).agg(F.flatten(F.collect_list("ranges")).alias("spans")), keep=True)


def _cut(tidy: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace ``text`` by its kept words, and say how many words there were and went."""
    for batch in batches:
        texts = batch.column(0)
        kept, total, gone = [], [], []
        for text, ranges in zip(texts, batch.column(1), strict=True):
            text, ranges = text.as_py(), ranges.as_py()
            parts = text.encode().split() if text is not None else []
            n = len(parts)
            if ranges:
                edge = np.zeros(n + 1, np.int32)
                for r in ranges:
                    edge[r["first"]] += 1
                    edge[r["last"]] -= 1
                parts = [p for p, c in zip(parts, np.cumsum(edge[:-1]), strict=True) if not c]
            kept.append(text if text is None or not (tidy or ranges) else b" ".join(parts).decode())
            total.append(n)
            gone.append(n - len(parts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), *batch.columns[2:]],
            names=["text", "n_words", "n_removed", *batch.schema.names[2:]])


def drop_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, tidy: bool = True) -> DataFrame:
    """The documents with every repeated passage taken out.

    ``text`` becomes the kept words joined by one space (null stays null; with
    ``tidy`` False a text without repeats stays as it is);
    ``n_words`` and ``n_removed`` are added (under other names if the input has
    these: see ``fresh``). Every input row and all other columns stay.
    """
    spans = repeated_spans(docs, window, seed).withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    rest = [c for c in docs.columns if c != "text"]
    n_words, n_removed = fresh(docs, "n_words", "n_removed")
    one = docs.select("text", text_mark().alias("_mark_"), packed_rest(docs, rest).alias("_rest"))
    both = one.join(spans, one["_rest.doc_id"].eqNullSafe(spans["_id"]) & (one["_mark_"] == spans["_mark"]), "left")
    text = both.select("text", "spans", "_rest")
    out = map_arrow(text, partial(_cut, tidy), "text string, n_words bigint, n_removed bigint", "_rest")
    return out.select(*[F.col("text") if c == "text" else F.col("_rest")[c].alias(c) for c in docs.columns],
                      F.col("n_words").alias(n_words), F.col("n_removed").alias(n_removed))
