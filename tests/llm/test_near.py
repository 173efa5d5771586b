"""Near-duplicate groups against all pairs."""

import random
import string

import pytest

from custos.llm import near

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text, k):
    w = (text or "").translate(LOWER).encode().split()
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute(rows, k, percent):
    """doc_id -> (set size, smallest doc_id reachable); rows without doc_id left out."""
    rows = [(i, shingle_set(t, k)) for i, t in rows if i is not None]
    label = {i: i for i, _ in rows}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, (i, x) in enumerate(rows):
        for j, y in rows[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                label[q] = p
    return {i: (len(x), find(i)) for i, x in rows}


@pytest.mark.parametrize("k", [2, 5])
def test_random_copies_equal_all_pairs(spark, k):
    rnd = random.Random(k)
    rows = []
    for g in range(25):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(1, 120))]
        for _ in range(rnd.randrange(1, 9)):
            text = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 12)):
                text[rnd.randrange(len(text))] = f"new{rnd.randrange(10**6)}"
            rows.append((" ".join(text).capitalize() if rnd.random() < 0.3 else " ".join(text)))
    # many short texts around one common line: alike, but few of them alike enough
    line = " ".join(f"common{i}" for i in range(12))
    rows += [line + "".join(f" tail{rnd.randrange(40)}" for _ in range(rnd.randrange(1, 6))) for _ in range(60)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_groups(docs, shingle=k).collect()}
    assert got == brute(rows, k, 80)


def test_pigeonhole_keys_find_every_pair_within_the_radius():
    rnd = random.Random(1)
    keys = near.chunk_keys(40, 4, 1)
    assert len(keys) == 40
    for _ in range(300):  # 19 differing positions anywhere leave one key untouched
        apart = set(rnd.sample(range(40), 19))
        assert any(not apart & set(k) for k in keys)


def test_hard_rows(spark, documents):
    got = near.near_groups(documents, shingle=2).collect()
    assert len(got) == documents.count()
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert of[1] == of[2] == of[14] == {(59, 1)} and of[3] == {(59, 1)}
    assert of[6] == {(0, 6)} and of[7] == {(0, 7)} and of[8] == {(0, 8)} and of[9] == of[10] == {(1, 9)}
    assert {c for _, c in of[None]} == {None} and {c for _, c in of[16]} == {16}


def test_one_document_of_each_group_stays(spark, documents):
    kept = near.keep_first(documents, shingle=2)
    assert kept.columns == documents.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: -1 if i is None else i)
    # both texts of 16 are unlike all others, so both stay
    assert ids == [None, None, 1, 4, 6, 7, 8, 9, 11, 12, 13, 15, 16, 16]


def test_rows_are_compared_by_text_not_by_id(spark):
    """Ids that repeat or are missing lose no unique text and keep no copy; the row that stays is defined."""
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(7, long, 1), (5, long + " more", 2), (None, long, 3), (7, "quite another text of this id", 4), (None, "alone and without id", 5),
            (None, "alone and without id", 6), (8, "alone and without id", 7), (7, None, 8), (7, None, 9), (None, "", 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    kept = [sorted(r.n for r in near.keep_first(d, shingle=2).collect()) for d in (docs, docs.repartition(4, "n"))]
    # 8 and 9 are equal in id and text: one stays, always the same
    assert kept[0] == kept[1] and set(kept[0]) - {8, 9} == {2, 4, 7, 10} and len(kept[0]) == 5


def test_empty_table(spark, nothing):
    assert near.near_groups(nothing).count() == 0 and near.keep_first(nothing).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    from custos.llm.components import connected
    from custos.llm.scratch import Scratch
    edges = [(i, i + 1) for i in range(40, 75)] + [(9, i) for i in range(10, 30)] + [(3, 3), (2, 1), (1, 2)]
    with Scratch(spark) as s:
        got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a bigint, b bigint"), s).collect()}
        assert connected(spark.createDataFrame([], "a bigint, b bigint"), s).count() == 0
    assert got == {**dict.fromkeys(range(40, 76), 40), **dict.fromkeys(range(9, 30), 9), 1: 1, 2: 1}
