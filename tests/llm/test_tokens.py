"""Token counts against a greedy longest match of each word."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from custos.llm import tokens
from custos.llm import words as W


def greedy(word, pieces, start):
    word, n, i = start + word, 0, 0
    while i < len(word):
        i = next(j for j in range(len(word), i, -1) if word[i:j] in pieces or j == i + 1)
        n += 1
    return n


@given(st.lists(st.binary(min_size=1, max_size=6).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=25),
       st.lists(st.text("abcé", min_size=1, max_size=30), max_size=20))
@settings(max_examples=60, deadline=None)
def test_small_vocabularies(pieces, words):
    a = tokens.automaton(pieces, start=b"_")
    have = set(pieces)
    chunk = list(W.words(pa.array([" ".join(words)], pa.string())))
    got = [n for w in chunk for n in a.counts(w.data, w.start, w.end).tolist()]
    assert got == [greedy(x.encode(), have, b"_") for x in words]


def test_public_vocabulary_on_whole_texts(spark):
    from custos.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    pieces = set(tokens.vocabulary())
    most = max(map(len, pieces))

    def count(word):
        word, n, i = tokens.START + word, 0, 0
        while i < len(word):
            i = next(j for j in range(min(len(word), i + most), i, -1) if word[i:j] in pieces or j == i + 1)
            n += 1
        return n

    got = {r.doc_id: (r.n_words, r.n_tokens) for r in QUERIES["op9_token_counts"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect():
        words = Counter(r.text.encode().split())
        assert got[r.doc_id] == (sum(words.values()), sum(count(w) * n for w, n in words.items()))


def test_hard_rows(spark, documents, nothing):
    out = tokens.count_tokens(documents)
    assert out.columns == [*documents.columns, "_n_words", "_n_tokens"]
    rows = out.collect()
    assert len(rows) == documents.count()
    assert all((r["_n_words"] == 0) == (r["_n_tokens"] == 0) == (not (r.text or "").split()) for r in rows)
    assert next(r for r in rows if r.doc_id == 11)["_n_words"] == 6000
    assert tokens.count_tokens(nothing).count() == 0


def test_mark_must_begin_a_piece():
    with pytest.raises(ValueError):
        tokens.automaton([b"a"], start=b"__")
    assert np.all(tokens.automaton([b"ab"], start=b"_").pops >= 0)
