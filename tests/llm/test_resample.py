"""Importance resampling against a plain version of its definition, and the quickselect by itself."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from custos.llm import resample as R
from custos.llm.scratch import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, ngrams):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i:i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent, least_words, ngrams, buckets, seed):
    """(n_features, weight, score, rank) for each (doc_id, text), rows told apart by their place."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, ngrams)[1])
    t = Counter(bucket(f) for x in target for f in features(x, ngrams)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in docs:
        words, found = features(text, ngrams)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        out.append([len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [i for i, r in enumerate(out) if r[0] >= least_words]
    able.sort(key=lambda i: (-out[i][3], docs[i][0] is None, docs[i][0] or 0))
    for rank, i in enumerate(able[:len(able) * percent // 100], 1):
        out[i][4] = rank
    return [tuple(r[1:]) for r in out]


@pytest.mark.parametrize("ngrams, least, percent", [(1, 1, 50), (2, 3, 34), (3, 20, 100), (1, 10_000, 50)])
def test_scores_and_ranks_are_those_of_the_definition(spark, ngrams, least, percent):
    rng = np.random.default_rng(5)
    vocabulary = ["Été", "naïve", "x", "ÀB", "don't", "a1b2", "汉字", "ZZ", "w" * 70, "w" * 64 + "é"]
    docs = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(0, 40)))) for i in rng.permutation(60)]
    docs += [(1000, None), (1001, ""), (1002, " ,;\t\n"), (None, "x zz x zz"), (1003, "\x00a\x7fb@c`d{e")]
    target = ["x x x zz", None, "", "汉字 x don't"]
    got = R.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(t,) for t in target], "text string"),
                     percent, least, ngrams, buckets=97, seed="s", keep=["doc_id"]).collect()
    want = brute(docs, target, percent, least, ngrams, 97, "s")
    assert sorted((r.doc_id or -1, r.n_features, r.weight, r.score, r["rank"] or 0) for r in got) == sorted(
        (d or -1, *w[:3], w[3] or 0) for (d, _), w in zip(docs, want, strict=True))


def test_crc_registers_of_many_words():
    words = [b"", b"a", b"hello", "été".encode(), b"x" * 64, b"y" * 65, b"z" * 1000]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    reg = R.feed(np.full(len(words), 0xFFFFFFFF, np.uint32), data, end - [len(w) for w in words], end)
    assert (~reg).tolist() == [zlib.crc32(w) for w in words]


@pytest.mark.parametrize("values", [range(2000), [5] * 700 + list(range(600)), [1, 2], [7] * 300])
def test_quickselect_equals_sorting(spark, values):
    """Every size of gap and heavy ties; the pivots are random, the result is not."""
    rows = [(int(v), int(v) % 3, i % 2) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "a bigint, b bigint, c bigint").repartition(5)
    with Scratch(spark) as s:
        table = s.table(table)
        for k in {1, len(rows) // 2, len(rows) * 9 // 10, len(rows)}:
            if k:
                assert R.kth(table, R.Key(("a", "b", "c")), k, s, pivots=7) == sorted(rows)[k - 1]


def test_equal_rows_fill_the_room_that_is_left(spark):
    """Rows alike in id and text: as many as fit are drawn, with ranks that follow each other."""
    docs = spark.createDataFrame([(3, "x y z")] * 10, "doc_id bigint, text string")
    got = R.resample(docs, docs, percent=70, least_words=1).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 8)) and len(got) == 10


def test_hard_rows_and_clashing_names(spark, documents, nothing):
    target = documents.select("text")
    more = documents.withColumns({"rank": documents.doc_id, "weight": documents.text, "k0": documents.doc_id, "row": documents.text})
    out = R.resample(more, target, percent=100, least_words=1)
    rows = out.collect()
    assert out.columns == [*more.columns, "n_features", "_weight", "_score", "_rank"] and len(rows) == documents.count()
    assert sorted(r["_rank"] for r in rows if r["_rank"]) == list(range(1, 1 + sum(r.n_features > 0 for r in rows)))
    assert R.resample(nothing, target).collect() == []
    assert R.resample(documents, target.limit(0), least_words=1).count() == documents.count()
