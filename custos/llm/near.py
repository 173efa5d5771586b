"""Near-duplicate groups: b-bit MinHash signatures and a multi-index Hamming join.

A document is its set of distinct k-word shingles (A-Z lower-cased). Documents
are linked if their sets' Jaccard similarity is at least ``percent`` / 100; a
group is a connected component of links.

1. *Signatures.* ``positions`` minima of the set under independent hash
   functions, ``bits`` low bits of each. Equal sets (128-bit set hash) become one
   row first, so exact copies, however many, are one signature.
2. *Multi-index.* The signature is split into chunks of ``chunk`` positions. Each
   chunk allows up to ``errors`` differing positions: one key for each choice of
   ``errors`` positions left out. By the pigeonhole principle every pair that
   differs in at most ``radius`` = chunks * (errors + 1) - 1 positions shares a
   key, and a pair beyond it does so with high probability: with the defaults
   (10 chunks of 4, one error) a pair of similarity exactly 0.8 is missed with
   probability 0.18 ** 10 < 4e-8.
3. *Candidates without all pairs.* A pair is plausible if the sizes allow the
   similarity and the signatures differ in at most ``reach`` positions; members of
   a key without a plausible partner there go (a semi-join, which forms no pairs). Within a
   key every member is paired with one lead only, the first under an order that changes from
   round to round; each set takes its most frequent leads. Pairs are confirmed on the full
   shingle sets of the whole texts, and confirmed links are merged to components.
4. *Across components.* After the star rounds, keys whose members lie in more than
   one component are left. Their members' shingles are ordered by rarity; sets
   that are similar enough share one of the rarest n - ceil(percent * n / 100) + 1 of
   each, so only pairs across components that share such a shingle, far enough from
   the end, are formed (documents that merely share a common line are not), and the
   plausible ones are confirmed. No link between different texts is lost that the index has found.

Hot groups: keys are counted with map-side aggregation; joins have one row a key on one side, so that
skewed keys split; copies are one row. Nothing is collected to the driver but
one number a round.

Rows: a null or wordless text has an empty set and is linked with nothing. A
row without doc_id takes no part and is its own group (component null, kept).
Rows that share a doc_id are one node. Every row of the input is returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custos.llm import words as W
from custos.llm.components import connected
from custos.llm.scratch import Scratch, map_arrow, packed_rest, text_mark

POSITIONS, BITS, CHUNK, ERRORS = 40, 16, 4, 1
# how many leads each set is confirmed against in each star round
STAR_PARTNERS = (1, 3)

_SKETCH = "doc_id bigint, mark bigint, n_shingles bigint, set_a bigint, set_b bigint, signature array<int>"


def _sketches(shingle: int, positions: int, bits: int):
    """Arrow batches of (doc_id, mark, text) to rows of ``_SKETCH``."""
    rng = np.random.Generator(np.random.PCG64(10))
    mul = (rng.integers(1, 2**64, positions, dtype=np.uint64) | W.U(1))[:, None]
    add = rng.integers(0, 2**64, positions, dtype=np.uint64)[:, None]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, set_a, set_b = (np.zeros(n, np.int64) for _ in range(3))
            sig = np.zeros((n, positions), np.int32)
            for i, x in enumerate(W.shingle_sets(batch.column("text"), shingle)):
                size[i] = len(x)
                if len(x):
                    set_a[i] = np.sum(x, dtype=np.uint64).astype(np.int64)
                    set_b[i] = np.sum(W.mix(x ^ W.U(0x5851F42D4C957F2D)), dtype=np.uint64).astype(np.int64)
                    low = np.full(positions, 2**64 - 1, np.uint64)
                    for j in range(0, len(x), 4096):
                        np.minimum(low, (x[None, j:j + 4096] * mul + add).min(1), out=low)
                    sig[i] = (W.mix(low) & W.U((1 << bits) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("mark"), pa.array(size), pa.array(set_a), pa.array(set_b),
                pa.ListArray.from_arrays(pa.array(np.arange(0, n * positions + 1, positions, dtype=np.int32)),
                                         pa.array(sig.ravel())),
            ], names=["doc_id", "mark", "n_shingles", "set_a", "set_b", "signature"])
    return sketch


def chunk_keys(positions: int, chunk: int, errors: int) -> list[tuple[int, ...]]:
    """The positions of each key: every chunk with every choice of ``errors`` left out."""
    return [kept for c in range(0, positions - chunk + 1, chunk)
            for kept in combinations(range(c, c + chunk), chunk - errors)]


def packed(signature: Column, positions: int) -> list[Column]:
    """The low four bits of each position, sixteen positions to a number."""
    out = []
    for lo in range(0, positions, 16):
        parts = [F.shiftleft(signature[p].cast("bigint").bitwiseAND(F.lit(15)), 4 * (p - lo)) for p in range(lo, min(lo + 16, positions))]
        out.append(reduce(Column.bitwiseOR, parts).alias(f"p{lo // 16}"))
    return out


def reach(positions: int, percent: int) -> int:
    """In how many positions signatures at the similarity may differ: the mean and 6.3 standard deviations
    (24 of 40 at 0.8, where the mean is 8; more differ with probability 1e-8)."""
    p = percent / 100
    return round(positions * (1 - p) + 6.3 * math.sqrt(positions * p * (1 - p)))


def plausible(a: DataFrame, b: DataFrame, positions: int, percent: int) -> Column:
    """Sizes allow the similarity and the packed signatures differ in at most ``reach`` positions
    (columns n, p0, p1 ... of ``a`` against _n, _p0, _p1 ... of ``b``)."""
    def differ(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    apart = sum((differ(a[f"p{i}"].bitwiseXOR(b[f"_p{i}"])) for i in range(-(-positions // 16))), F.lit(0))
    return ((a["n"] * 100 >= b["_n"] * percent) & (b["_n"] * 100 >= a["n"] * percent)
            & (apart <= reach(positions, percent)))


def _grams(shingle: int):
    """Arrow batches of (id, mark, component, text) to one row for each shingle of the text."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(W.shingle_sets(batch.column("text"), shingle))
            n = np.array([len(x) for x in found], np.int64)
            row = np.repeat(np.arange(len(n)), n)
            for lo in range(0, len(row), 1 << 18):
                at = pa.array(row[lo:lo + (1 << 18)])
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).take(at) for c in ("id", "mark", "component")), pa.array(n.astype(np.int32)).take(at),
                    pa.array(np.concatenate(found).view(np.int64)[lo:lo + (1 << 18)]),
                ], names=["id", "mark", "component", "n", "gram"])
    return explode


def _confirm(shingle: int, percent: int):
    """Arrow batches of (a, b, text_a, text_b) to the pairs whose sets are similar enough."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            both = zip(W.shingle_sets(batch.column("text_a"), shingle),
                       W.shingle_sets(batch.column("text_b"), shingle), strict=True)
            for i, (x, y) in enumerate(both):
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) > 0:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))
    return confirm


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, positions: int = POSITIONS,
                bits: int = BITS, chunk: int = CHUNK, errors: int = ERRORS, by_text: bool = False) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id) of every row of ``docs``. A node of the graph is a doc_id, with all texts that
    have it; rows without one are linked with nothing. With ``by_text`` a node is a doc_id, or none, with one text, and
    component_id is the number of a node: numbers rise with doc_id (none comes last), then mark, a 64-bit hash of the text."""
    docs = docs.select("doc_id", (F.xxhash64("text") if by_text else text_mark()).alias("mark"), "text")
    with Scratch(docs.sparkSession) as s:
        sketch = s.table(map_arrow(docs, _sketches(shingle, positions, bits), _SKETCH), keep=True)
        if by_text:
            order = [F.col("doc_id").asc_nulls_last(), F.col("mark")]
            number = s.table(sketch.select("doc_id", "mark").distinct().orderBy(*order).withColumn("node", F.monotonically_increasing_id()))
            of = number.withColumnsRenamed({"doc_id": "_doc_id", "mark": "_mark"})
            sketch = s.table(sketch.join(of, sketch["doc_id"].eqNullSafe(of["_doc_id"]) & (sketch["mark"] == of["_mark"])).drop("_doc_id", "_mark"), keep=True)
        else:
            sketch = sketch.withColumn("node", F.col("doc_id"))
        full = sketch.where("node is not null and n_shingles > 0")
        # one row for each different set; id is the smallest node that has it
        sets = s.table(full.groupBy("set_a", "set_b", F.col("n_shingles").alias("n")).agg(
            F.min("node").alias("id"), F.first("signature").alias("signature")).select(
            "*", *packed(F.col("signature"), positions)), keep=True)
        lanes = [c for c in sets.columns if c[0] == "p"]
        keys = F.array(*[F.xxhash64(F.lit(i), *[F.col("signature")[p] for p in kept])
                         for i, kept in enumerate(chunk_keys(positions, chunk, errors))])
        keyed = sets.select("id", "n", *lanes, F.explode(keys).alias("key"))
        # counts are tables of their own, so that the joins with them can split a hot key
        shared = s.table(keyed.groupBy("key").count().where("count > 1").select("key"))
        member = s.table(keyed.join(shared, "key"))
        # the part of the index that can join anything: members with a plausible partner under the same key
        other = member.select(*[F.col(c).alias(f"_{c}") for c in member.columns])
        near = plausible(member, other, positions, percent) & (member["id"] != other["_id"])
        member = s.table(member.join(other, (member["key"] == other["_key"]) & near, "left_semi"))
        if by_text:
            of = of.join(member.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
            texts = docs.join(of, docs["doc_id"].eqNullSafe(of["_doc_id"]) & (docs["mark"] == of["_mark"])).select(
                F.col("node").alias("doc_id"), "mark", "text").dropDuplicates(["doc_id"])  # equal rows are one node
        else:
            texts = docs.join(member.select("id").distinct(), F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "mark", "text")
        texts = s.table(texts)
        label = s.table(member.select(F.col("id").alias("node")).distinct().withColumn("component", F.col("node")))

        def merged(pairs: DataFrame, label: DataFrame) -> DataFrame:
            """``label`` after the links that hold among ``pairs`` (a, b)."""
            ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
            tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
            links = map_arrow(pairs.join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b"),
                              _confirm(shingle, percent), "a bigint, b bigint")
            la, lb = (label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
            links = links.join(la, "a").join(lb, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
            up = connected(links, s).select(F.col("node").alias("component"), F.col("component").alias("up"))
            return s.table(label.join(up, "component", "left").select(
                "node", F.coalesce("up", "component").alias("component")), keep=True)

        for turn, partners in enumerate(STAR_PARTNERS):
            at = member.join(label.withColumnRenamed("node", "id"), "id")
            # the first round leads by id, so that a group's keys agree; the next by chance, so that they don't
            order = F.xxhash64("id", "key") if turn else F.lit(0).cast("bigint")
            lead = F.min(F.struct(order.alias("order"), *member.drop("key").columns, "component"))
            first = s.table(at.groupBy("key").agg(lead.alias("lead"), F.min("component").alias("lo"),
                                                  F.max("component").alias("hi")).where("lo < hi").select(
                "key", *[F.col(f"lead.{c}").alias(f"_{c}") for c in (*member.drop("key").columns, "component")]))
            stars = at.join(first, "key").where(plausible(at, first, positions, percent) & (F.col("component") != F.col("_component")))
            stars = stars.groupBy("id", "_id").agg(F.count(F.lit(1)).alias("keys"))
            nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("keys"), "_id"))
            label = merged(stars.withColumn("nth", nth).where(F.col("nth") <= partners).select(
                F.col("id").alias("a"), F.col("_id").alias("b")), label)
        at = s.table(member.join(label.withColumnRenamed("node", "id"), "id"))
        split = s.table(at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi"))
        at = s.table(at.join(split.select("key"), "key"))
        other = at.select(*[F.col(c).alias(f"_{c}") for c in at.columns])
        near = plausible(at, other, positions, percent) & (at["component"] != other["_component"])
        left = s.table(at.join(other, (at["key"] == other["_key"]) & near, "left_semi").select("id", "component").distinct())
        grams = texts.join(left, texts["doc_id"] == left["id"]).select("id", "mark", "component", "text")
        grams = s.table(map_arrow(grams, _grams(shingle), "id bigint, mark bigint, component bigint, n int, gram bigint"))
        often = s.table(grams.groupBy("gram").count().where("count > 1"))
        # shingles that one set alone has are its rarest: they take the first places, but are no keys
        alone = s.table(grams.join(often, "gram").groupBy("id", "mark").agg(F.count(F.lit(1)).alias("others")))
        nth = F.row_number().over(Window.partitionBy("id", "mark").orderBy("count", "gram"))
        rare = grams.join(often, "gram").join(alone, ["id", "mark"]).withColumn("place", F.col("n") - F.col("others") + nth)
        rare = s.table(rare.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select(
            "gram", "id", "component", "n", "place"))
        x, y = (rare.select("gram", *[F.col(c).alias(f"{c}_{v}") for c in ("id", "component", "n", "place")]) for v in "ab")
        # the first shingle in order that two sets share leaves room for one more than the rest of the shorter tail
        room = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
        fits = (room * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))) & (F.col("component_a") < F.col("component_b"))
        sized = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
        pairs = x.join(y, (x["gram"] == y["gram"]) & fits & sized).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
        one, two = (sets.select(*[F.col(c).alias(f"{u}{c}") for c in ("id", "n", *lanes)]) for u in ("", "_"))
        pairs = pairs.join(one, F.col("a") == F.col("id")).join(two, F.col("b") == F.col("_id")).where(
            plausible(one, two, positions, percent)).select("a", "b")
        label = merged(pairs, label)
    group = sets.join(label.withColumnRenamed("node", "id"), "id", "left").select(
        "set_a", "set_b", F.coalesce("component", "id").alias("group"))
    linked = full.join(group, ["set_a", "set_b"]).select("node", "group").groupBy("node").agg(F.min("group").alias("group"))
    return sketch.select("doc_id", "mark", "n_shingles", "node").join(linked, "node", "left").select(
        "doc_id", "mark", "n_shingles", F.coalesce("group", "node").alias("component_id"), *(["node"] if by_text else []))


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near duplicates: of each group one row stays, that with the smallest doc_id (none comes
    last), then the smallest hash of its text. Rows are compared by their own texts, whatever their ids: those that share
    an id, or have none, go only if a near duplicate stays. Rows equal in id and text are one, that with the least hash of all
    its columns; texts without words have no other duplicates. All columns stay as they are."""
    lead = near_groups(docs, shingle, percent, by_text=True).where("node = component_id").select(
        F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    rows = docs.select(packed_rest(docs, docs.columns).alias("row"))
    mark = F.xxhash64("row.text")
    kept = rows.join(lead, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (mark == F.col("_mark")), "left_semi")
    plain = [F.col("row")[f.name] for f in docs.schema.fields if f.dataType.typeName() != "map"]
    kept = kept.groupBy(F.col("row.doc_id").alias("_id"), mark.alias("_mark")).agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
