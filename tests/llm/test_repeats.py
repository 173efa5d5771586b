"""Substring deduplication against a count of every window."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from custos.llm import repeats


def brute(texts, window):
    """(words, removed, kept text) of each text."""
    split = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("window", [8, 35])
def test_random_texts_equal_brute_force(spark, window):
    rnd = random.Random(window)
    pool = [[rnd.choice("abcdefgh") + str(rnd.randrange(40)) for _ in range(rnd.randrange(5, 90))] for _ in range(12)]
    texts = []
    for _ in range(80):
        parts = [rnd.choice(pool)[rnd.randrange(4):] for _ in range(rnd.randrange(1, 4))]
        own = [f"own{rnd.randrange(10**9)}" for _ in range(rnd.randrange(30))]
        texts.append(rnd.choice([" ", "\n", " \x0b"]).join(own + sum(parts, []) + own[:3]))
    texts += ["x " * 90, "a b " * 50, "", None, texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.text or "") for r in repeats.drop_repeats(docs, window, seed=4).collect()}
    assert got == dict(enumerate(brute(texts, window)))


def test_equal_blocks_of_a_document_are_one_row():
    passage = " ".join(f"w{i}" for i in range(80))
    far = f"{passage} {' '.join(f'own{i}' for i in range(60))} {passage}"
    texts = ["left right " * 400, "x " * 300, "left right " * 400, far, None, "short"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts)],
        names=["doc_id", "mark", "text"])
    rows = [r for b in repeats._blocks(35, 6)([batch]) for r in b.to_pylist()]
    assert len({(r["doc_id"], r["anchor"], r["content"]) for r in rows}) == len(rows)
    assert sum(r["doc_id"] == 0 for r in rows) <= 3 and sum(r["doc_id"] == 1 for r in rows) == 1
    for i, n in ((0, 800), (1, 300), (3, 220)):
        mine = [r for r in rows if r["doc_id"] == i]
        assert sum(r["windows"] * r["times"] for r in mine) == n - 34
        assert {k for r in mine for g in r["ranges"] for k in range(g["first"], g["last"])} == set(range(n))
    # blocks apart keep their ranges apart
    assert any(len(r["ranges"]) == 2 and r["ranges"][1]["first"] - r["ranges"][0]["first"] == 140 for r in rows if r["doc_id"] == 3)


def test_repeats_within_and_across_documents_equal_brute_force(spark):
    passage, other = (" ".join(f"{x}{i}" for i in range(60)) for x in "po")
    texts = [f"a {'left right ' * 90} {passage} b {passage}", f"c {'left right ' * 40}", "left right " * 17 + "left", "left right " * 17,
             f"{other} d {'left right left ' * 30}", f"{passage} {other[:-4]} e", "x " * 100, "x " * 35, "y " * 36, "z " * 35]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.text or "") for r in repeats.drop_repeats(docs).collect()}
    assert got == dict(enumerate(brute(texts, 35)))


def test_hard_rows(spark, documents):
    out = repeats.drop_repeats(documents)
    assert out.columns[:len(documents.columns)] == documents.columns and out.columns[-2:] == ["_n_words", "n_removed"]
    rows = out.collect()
    texts = [r.text for r in documents.collect()]
    want = Counter((n, gone, kept) for n, gone, kept in brute(texts, 35))
    assert Counter((r["_n_words"], r.n_removed, r.text or "") for r in rows) == want
    assert sum(r.text is None for r in rows) == 2


def test_untouched_texts_stay_as_they_are(spark, documents):
    rows = repeats.drop_repeats(documents, tidy=False).where("n_removed = 0").collect()
    before = Counter(r.text for r in documents.collect())
    assert all(before[r.text] for r in rows)


def test_empty_table(spark, nothing):
    assert repeats.drop_repeats(nothing).count() == 0


def test_query_digest(spark):
    from custos.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (n, gone, hashlib.sha256(kept.encode()).hexdigest())
            for r, (n, gone, kept) in zip(docs, brute([r.text for r in docs], 35), strict=True)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op2_substring_dedup"](spark, sf).collect()}
    assert got == want
