"""Fill-in-middle: every document against a plain version, and exact round trips."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from custos.llm import infill as I

UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ ]* |[^ ]+", "char": r"(?s)."}


def brute(doc_id, text, plan):
    """(n, form, prefix_chars, middle_chars, output)"""
    text = text or ""
    units = re.findall(UNIT[plan.unit], text)
    h = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in I.MARKS) or h3 % 100 >= plan.percent:
        return len(units), "plain", None, None, text
    x, y, z = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < plan.spm_percent:
        return len(units), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return len(units), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


TEXTS = ["a\nb\nc\n", "a\nb\nc", "\n\n\n", "one line", "é\n汉字\n😀 x\n" * 7, "no <P> here\n", "<", "<P", "P>\nS>\n<M", "> <S\n>", "\r\n\x00\n", " a  b ",
         "<\nP>\n", "long " * 9000 + "\n" + "ü" * 70_000, "l\n" * 20_000, "", None]


@pytest.mark.parametrize("plan", [I.Plan(), I.Plan("char", 70, 30, "s", chunk=5), I.Plan("word", 100, 100, chunk=1), I.Plan("line", 100, 0, chunk=3),
                                  I.Plan(percent=0)])
def test_digests_and_texts_equal_a_plain_version(spark, plan):
    few = TEXTS if plan.chunk > 100 else [t for t in TEXTS if len(t or "") < 1000]
    rows = [(i, t) for k in range(5) for i, t in enumerate(few, 1000 * k)] + [(None, "x\ny\nz"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = sorted((d or -1, *(v if v is not None else -1 for v in w[:4]), sha(w[4]), sha(t)) for d, t in rows for w in [brute(d, t, plan)])
    got = I.digests(docs, plan)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(tuple(-1 if v is None else v for v in (r.doc_id or -1, *r[1:])) for r in got.collect()) == want
    texts = I.transform(docs, plan)
    back = texts.select("doc_id", "text", "form", I.restored(F.col("text"), F.col("form")).alias("back")).collect()
    assert sorted((r.doc_id or -1, r.text, r.form, r.back) for r in back) == sorted(
        (d or -1, w[4], w[1], t or "") for d, t in rows for w in [brute(d, t, plan)])


def test_pieces_are_whole_units_of_bounded_size():
    plan = I.Plan(chunk=10)
    text = b"ab\ncdef\nghijklmnopqrstuvw\nx\n\n"
    pieces = plan.chunks(text, plan.ends(text), 0, 5)
    assert b"".join(pieces) == text and max(map(len, pieces)) <= 10
    assert pieces[0] == b"ab\ncdef\n"  # cut where a unit ends; only the long unit is cut inside
    assert plan.chunks(text, plan.ends(text), 2, 2) == [b""]


def test_one_shuffle_and_two_sorts(spark, documents):
    plan = I.digests(documents, I.Plan())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2


def test_hard_rows_and_clashing_names(spark, documents, nothing):
    rows = {(r.doc_id, r.text or "") for r in documents.collect()}
    got = I.digests(documents, I.Plan())
    assert sorted(r.restored_sha256 for r in got.collect()) == sorted(sha(r.text) for r in documents.collect())
    more = documents.withColumns({"form": F.lit("kept"), "rest": F.lit(1), "row": F.lit("r"), "data": F.lit(b"d")})
    out = I.transform(more, I.Plan())
    assert out.columns == [*more.columns, "_form"] and out.where("form = 'kept' and rest = 1 and row = 'r'").count() == documents.count()
    assert {(r.doc_id, r.back) for r in out.select("doc_id", I.restored(F.col("text"), F.col("_form")).alias("back")).collect()} == rows
    assert I.digests(nothing, I.Plan()).collect() == [] and I.transform(nothing, I.Plan()).collect() == []
