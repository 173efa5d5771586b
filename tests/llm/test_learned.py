"""Quality, language and page extraction: held-out accuracy, and the exact parts against brute force."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from custos.llm import language, pages, quality

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 40 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_pairs_rank_good_above_bad():
    rng = np.random.Generator(np.random.PCG64(0))
    good, bad = rng.normal(1, 1, (300, 2)), rng.normal(-1, 1, (60, 2))
    m = quality.fit(good, bad)
    assert min(m.weights) > 0 and m.steepness > 0
    margin = np.concatenate([good, bad]) @ np.array(m.weights)
    assert np.mean(margin < m.threshold) == pytest.approx(60 / 360, abs=0.01)


def test_quality_threshold_is_of_all_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    x = docs.toPandas().merge(labels.toPandas(), on="doc_id")
    ids = spark.createDataFrame(x[["doc_id"]]).select("doc_id", quality.held_out(F.col("doc_id")).alias("held")).toPandas()
    x = x[~ids.held.to_numpy()]
    rows, good = quality.figures(pa.array(x.text, pa.string())), x.quality.to_numpy() == 1
    known = spark.createDataFrame([(int(i), f.tolist()) for i, f in zip(x.doc_id, rows, strict=True)], "doc_id bigint, figures array<double>")
    assert min(good.sum(), (~good).sum()) > 20
    capped = quality.learn(known, labels, max_rows=20)
    margin = rows @ np.array(capped.weights)
    assert capped.threshold == pytest.approx(np.quantile(margin, (~good).mean(), method="midpoint"), abs=1e-9)
    z = lambda k: (margin - capped.threshold) * k + np.log(0.3 / 0.7)
    loss = lambda k: np.logaddexp(0, np.where(good, -z(k), z(k))).sum() + 0.005 * k * k
    assert loss(capped.steepness) <= min(loss(capped.steepness * f) for f in (0.99, 1.01))
    full = quality.learn(known, labels)
    model = quality.calibrate(quality.Model(full.weights, 0.0, 1.0), known.join(labels, "doc_id"), int((~good).sum()))
    assert (model.threshold, model.steepness) == pytest.approx((full.threshold, full.steepness), abs=1e-6)


@pytest.mark.parametrize("few", [1, 5, 10_000])
def test_nth_is_exact(spark, few):
    values = [float(v) for v in np.random.Generator(np.random.PCG64(3)).normal(size=200)] + [0.25] * 100 + [1e9]
    df = spark.createDataFrame([(v,) for v in values], "m double")
    assert [quality.nth(df, n, few, 8) for n in (0, 120, 160, 299, 300)] == [sorted(values)[n] for n in (0, 120, 160, 299, 300)]


def test_quality_hard_rows(spark, documents, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, None, 0), (None, 1, 0), (9, 1, 1), (9, 1, 1), (11, 0, 0)],
                                   "doc_id bigint, quality int, toxic int")
    rows = quality.score(documents, labels).collect()
    assert len(rows) == documents.count() and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    assert quality.keep_good(documents, labels).columns == documents.columns
    assert quality.score(nothing, labels).count() == 0 and quality.keep_good(nothing, labels).count() == 0
    none = {r.score for r in quality.score(documents, labels.where("false")).collect()}
    assert none == {0.5}


def test_labels_lang_and_source_are_no_inputs(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    a = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    held = docs.where(quality.held_out(F.col("doc_id"))).select("doc_id")
    b = {r.doc_id: r.score for r in quality.score(docs, labels.join(held, "doc_id", "left_anti")).collect()}
    assert a == b


def test_forward_backward_equals_enumeration(monkeypatch):
    monkeypatch.setattr(language, "STRETCH", 2)
    rng = np.random.Generator(np.random.PCG64(1))
    score, trans, bounds = rng.normal(size=(8, 3)), rng.normal(size=(3, 3)), np.array([0, 5, 5, 8])
    p, joint, log_z = language.marginals(score, bounds, trans)
    want, want_joint, want_z = np.zeros((8, 3)), np.zeros((3, 3)), 0.0
    for a, b in ((0, 5), (5, 8)):
        z, part, pair = 0.0, np.zeros((b - a, 3)), np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=b - a):
            e = np.exp(sum(score[a + i, y[i]] for i in range(b - a)) + sum(trans[u, v] for u, v in itertools.pairwise(y)))
            e *= np.exp(trans[:, y[0]]).mean()  # chains begin in a uniform state
            z += e
            part[np.arange(b - a), y] += e
            for u, v in itertools.pairwise(y):
                pair[u, v] += e
        want[a:b], want_joint, want_z = part / z, want_joint + pair / z, want_z + np.log(z)
    assert np.allclose(p, want) and np.allclose(joint, want_joint) and log_z == pytest.approx(want_z)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(docs.select("doc_id", "text"), language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_words_of_mixed_text_get_their_own_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs)
    of = {lang: " ".join(docs.where((F.col("lang") == lang) & (F.length("text") > 800)).orderBy("doc_id").first().text.split()[:40])
          for lang in ("de", "fr")}
    out = language.identify(spark.createDataFrame([(1, of["de"] + " " + of["fr"])], "doc_id bigint, text string"), model).first()
    label = [r.lang for r in out.runs for _ in range(r.first, r.last)]
    assert len(label) == 80 and np.mean([a == b for a, b in zip(label, ["de"] * 40 + ["fr"] * 40, strict=True)]) > 0.9


def test_language_hard_rows(spark, documents, nothing):
    rows = language.identify(documents.select("doc_id", "text"), language.learn(documents)).collect()
    texts = {r.doc_id: r for r in rows}
    assert len(rows) == documents.count()
    assert all(texts[i].lang_pred == "und" and texts[i].score == 0 and texts[i].runs == [] for i in (6, 7, 8, 13))
    assert texts[11].lang_pred in ("de", "en")
    nobody = language.learn(documents.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identify(documents, nobody).collect()} == {"und"}
    assert language.identify(nothing, language.learn(nothing)).count() == 0


@pytest.fixture(scope="module")
def page_model():
    return pages.fit(pages.labelled_pages())


def test_pages_held_out(page_model):
    right = total = 0
    for page in pages.labelled_pages(150, seed=99):
        chain = pages.blocks(page)
        right += sum(a == b.main for a, b in zip(page_model.labels(chain), chain, strict=True))
        total += len(chain)
    assert right / total > 0.985


def test_viterbi_equals_enumeration():
    rng = np.random.Generator(np.random.PCG64(2))
    for _ in range(30):
        chain = pages.blocks("".join(f"<p class=x{'abcdefg'[i]}>t{i}</p>" for i in range(6)))
        w = {f"named x{c}": float(rng.normal() * 2) for c in "abcdefg"}
        t = rng.normal(size=(2, 2)) * 2
        model = pages.Model(w, tuple(map(tuple, t.tolist())))
        e = [sum(w.get(f, 0) for f in pages.features(b)) for b in chain]
        best = max(itertools.product([0, 1], repeat=6), key=lambda y: sum(e[i] * y[i] for i in range(6))
                   + max(t[0, y[0]], t[1, y[0]]) + sum(t[a, b] for a, b in itertools.pairwise(y)))
        assert model.labels(chain) == [bool(y) for y in best]


def test_every_page_of_the_table(spark, page_model):
    """The article's blocks, read with another parser."""
    import re
    from html import unescape

    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in pages.main_text(spark.read.parquet(f"{SF}/pages.parquet"), page_model).collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?(?:p|h1|h2|ul|li)>", article)]
        want = "\n\n".join(x for x in parts if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


def test_page_parts(page_model):
    page = """<html><head><title>T</title><style>p{}</style></head><body><div class="cookie-notice"><p>We use cookies.</p></div>
      <nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A  title &amp; more</h1><p>First paragraph of the text, long enough.
      <p>Second &lt;one&gt;&nbsp;with <b>bold</b> words and more of them.</p><script>var x = "</p><p>no</p>";</script>
      <div class="ad">Buy this now.</div><p>Third paragraph, which ends the text here.</p></article>
      <section id="comments"><div class="comment"><p>I do not agree with this article at all, sorry.</p></div></section>
      <form><label>Mail</label><input></form><footer>&copy; us</footer>"""
    assert page_model.text(page) == ("A title & more\n\nFirst paragraph of the text, long enough.\n\nSecond <one> with bold words "
                                     "and more of them.\n\nThird paragraph, which ends the text here.")


@pytest.mark.parametrize("part", ["<svg width=9 />", "<svg/>", "<math/>", "<math display='block'/>", "<object data=x.swf>", "<svg class=icon>"])
def test_an_embedded_part_does_not_end_the_page(page_model, part):
    page = ("<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A long enough title</h1><p>First paragraph of the text, "
            f"long enough. {part}</p><p>Second paragraph, which ends the text here.</p></article><footer>&copy; us</footer>")
    assert page_model.text(page) == ("A long enough title\n\nFirst paragraph of the text, long enough.\n\n"
                                     "Second paragraph, which ends the text here.")


def test_formulas_are_text_and_drawings_are_not(page_model):
    page = ("<article><h1>A long enough title</h1><p>The sum is <math><mi>a</mi><mspace/><mo>+</mo><mi>b</mi></math> for all of them, "
            "as was said.<svg><text>label</text></svg></p><p>Second paragraph <svg href=a/>gone</svg>, which ends the text here.</p></article>")
    assert page_model.text(page) == ("A long enough title\n\nThe sum is a+b for all of them, as was said.\n\n"
                                     "Second paragraph , which ends the text here.")


def test_digit_share_is_of_the_whole_block():
    block = lambda text: pages.Block((("p",),), text, 0, False)
    assert "digits" not in pages.features(block("7" * 200 + " word" * 400))
    assert "digits" in pages.features(block("word " * 40 + "7" * 400))


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<<p>", "no tags", "<p", "<script>x", "<!-- open", "</p></div>", "<p>" * 3000, "<a 'x" * 500])
def test_broken_pages_do_not_fail(page_model, html):
    assert isinstance(page_model.text(html), str)


def test_page_rows(spark, page_model):
    rows = [(1, "u", None, "x"), (1, "u", "", "x"), (None, None, "<article><p>Some text here.</p></article>", "x")]
    out = pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"), page_model)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == 3
    assert sorted((r.page_id or 0, r.n_chars) for r in out.collect())[1:] == [(1, 0), (1, 0)]


def test_figures_of_empty_texts():
    x = quality.figures(pa.array(["", None, "a"], pa.string()))
    assert x.shape == (3, len(quality.FIGURES)) and not x[:2].any()


def test_deep_pages_take_linear_time_and_memory():
    """Unclosed elements nested fifty thousand deep, with text, names, links and stray ends at every level."""
    import time
    import tracemalloc

    model = pages.Model({"any": 9.0, "in div": 0.1, "named x": 0.2, "in a": -0.1, "leaf div/p": 0.3}, ((0.0, 0.0), (0.0, 0.0)))

    def cost(n):
        page = "".join(f"<div class=x{i}>a </span></article>" + ("<a><b><p>t" if i % 3 == 0 else "<li>u") for i in range(n))
        begun = time.process_time()
        tracemalloc.start()
        text = model.text(page)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return time.process_time() - begun, most, text.count("a")

    small, large = cost(5_000), cost(50_000)
    assert large[2] == 50_000 and large[0] < 30 * small[0] and large[1] < 20 * small[1]
