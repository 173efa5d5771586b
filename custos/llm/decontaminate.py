"""Benchmark decontamination: MinHash containment search by one bottom-k hash join.

Which test items lie, to at least ``percent`` of their distinct five-word
shingles, inside which documents? Items are short and documents long, so Jaccard
signatures of whole documents don't work; containment is searched by bottom-k
MinHash. With
q shingles an item keeps its q - ceil(percent * q) + 1 least shingle hashes:
a document that contains ``percent`` of the item misses too few shingles to miss
all of these, so candidate search loses nothing, whatever the size of the item. Document shingles above the
greatest hash of all sketches cannot match and go before the join. This one global bound replaces the
size partitions of the dealt method: ``part`` is computed, but decides nothing. Candidates are confirmed by
exact containment of the shingles' words, not hashes.

DataFrame expressions only. The sketches and items are broadcast only if their
counted rows stay below a bound; beyond it they are shuffle-joined on the hash.

Words are maximal runs without 0x20 and 0x09-0x0D, lower-cased. An item or
document of one to four words has its whole sequence as its one shingle; null or
wordless texts match nothing. Rows that share a doc_id are told apart by their
text; an item_id with several rows is several items of that name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custos.llm.scratch import Scratch, fresh, text_mark

SHINGLE, PERCENT = 5, 80
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table) to be broadcast if it has at most ``rows`` rows, as counted."""
    return F.broadcast(df) if df.count() <= rows else df


def word_list(text: str | Column) -> Column:
    """Words of a text, lower-cased. Plain replacements and a split at one character are
    many times as fast as a split by pattern."""
    text = F.lower(text)
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def grams(df: DataFrame, k: int) -> DataFrame:
    """One row for each k-word shingle of ``words``, in columns g1 .. gk; a list of fewer words
    gives one row, with nulls. No lambda, so rows are made in generated code."""
    shifted = [F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"g{i + 1}") for i in range(k)]
    rest = [c for c in df.columns if c != "words"]
    rows = df.select(*rest, F.posexplode(F.arrays_zip(F.col("words").alias("g1"), *shifted[1:])).alias("at", "g"))
    return rows.select(*rest, "at", "g.*").where((F.col("at") == 0) | F.col(f"g{k}").isNotNull()).drop("at")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, not again for each element of a lambda inside."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _each_shingle(words: Column, k: int, last: Callable[[Column], Column]) -> Column:
    """``last`` of every k-word shingle in order; null for a list without words."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))),
                                lambda i: last(F.array_join(F.slice(w, i, k), " ")))
    return _let(words, lambda w: F.when(F.size(w) >= 1, one(w)))


def shingles(words: Column, k: int) -> Column:
    """Distinct k-word shingles as texts; null for a list without words."""
    return F.array_distinct(_each_shingle(words, k, lambda s: s))


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """(doc_id, mark, item_id, n_shingles, n_found) for each item of ``items`` (item_id, text)
    and document that holds at least ``percent`` per cent of its shingles."""
    docs = docs.select("doc_id", text_mark().alias("mark"), "text").where("text is not null")
    parts, size = [f"g{i + 1}" for i in range(k)], F.col("n_shingles")
    with Scratch(docs.sparkSession) as s:
        item = s.table(items.select("item_id", word_list("text").alias("words")).where("size(words) > 0").distinct().select(
            "item_id", "words", F.xxhash64("item_id", "words").alias("item"), shingles(F.col("words"), k).alias("item_shingles")
        ).withColumn("n_shingles", F.size("item_shingles")))
        # the q - ceil(percent * q / 100) + 1 least hashes; partitions by the power of two of q
        least = size - F.ceil(size * percent / 100) + 1
        hashed = grams(item.select("item", "n_shingles", "words"), k).select(
            "item", "n_shingles", F.xxhash64(*parts).alias("hash")).distinct()
        nth = F.row_number().over(Window.partitionBy("item").orderBy("hash"))
        sketch = s.table(hashed.withColumn("nth", nth).where(F.col("nth") <= least).select(
            "item", F.floor(F.log2(size)).alias("part"), "hash"))
        bound = sketch.groupBy("part").agg(F.max("hash").alias("most")).agg(F.max("most")).first()[0]
        if bound is None:
            kind = items.schema["item_id"].dataType
            return docs.where(F.lit(False)).select("doc_id", "mark", F.lit(None).cast(kind).alias("item_id"),
                                                   F.lit(0).alias("n_shingles"), F.lit(0).alias("n_found"))
        rows = grams(docs.select("doc_id", "mark", word_list("text").alias("words")), k).select(
            "doc_id", "mark", F.xxhash64(*parts).alias("hash"))
        met = rows.where(F.col("hash") <= bound).join(small(sketch), "hash")
        found = s.table(met.groupBy("doc_id", "mark", "item").agg(F.first("part").alias("part")))
        near = small(found).withColumnsRenamed({"doc_id": "d", "mark": "m"})
        pair = docs.join(near, docs["doc_id"].eqNullSafe(near["d"]) & (docs["mark"] == near["m"])).join(small(item.drop("words")), "item")
        common = F.size(F.array_intersect(shingles(word_list("text"), k), "item_shingles"))
        sure = pair.select("doc_id", "mark", "item_id", "item", "n_shingles", common.alias("n_found")).where(
            F.col("n_found") * 100 >= size * percent)
        return s.table(sure.distinct().drop("item"), keep=True)


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """The documents that contain no item. Rows and columns of the others stay as they are."""
    d, m, mark = fresh(docs, "hit_id", "hit_mark", "row_mark")
    hit = contained_items(docs, items, percent, k).select(F.col("doc_id").alias(d), F.col("mark").alias(m)).distinct()
    with Scratch(docs.sparkSession) as s:
        hit = small(s.table(hit, keep=True))
    marked = docs.withColumn(mark, text_mark())
    return marked.join(hit, marked["doc_id"].eqNullSafe(hit[d]) & (marked[mark] == hit[m]), "left_anti").drop(mark)
