"""Ranked search: matches and scores against a plain scan, and which parts of the index a query reads."""

import math
import re

import pytest

from custos.operators import search as S
from tests.helpers import catalog, urn

NAMES = ["abcabcabc", "ABCABC", "xabcab", "ab", "orders_daily", "Orders Daily", "daily orders orders", "ümläut Straße", "a.b-c d", None, "abababab", "orders"]


@pytest.fixture(scope="module")
def index(spark):
    assets = [dict(asset_id=i, urn=urn(i, n), name=n, platform="p%d" % (i % 2), description="about orders" if i % 3 == 0 else None) for i, n in enumerate(NAMES)]
    cat = catalog(spark, assets, tags=[(1, "orders"), (2, "orders"), (3, "abc")], domains=[("urn:li:domain:daily", "Daily"), ("urn:li:domain:none", None)],
                  principals=[("urn:li:corpuser:ann", "Ann Orders", None, True), ("urn:li:corpGroup:abc", None, None, True)])
    return S.build_index(cat, buckets=5), [r.asDict() for r in S.entities(cat).collect()]


def text(e):
    return " ".join(x for x in (e["name"], e["urn"], e["description"]) if x is not None).lower()


def said(x):
    return re.findall(r"[^\W_]+", (x or "").lower())


def brute(entities, query, types=None, platforms=None):
    n, total = len(entities), sum(len(said(e[f])) for e in entities for f in S.WEIGHTS)
    tf = {w: {i: c for i, e in enumerate(entities) if (c := sum(k * said(e[f]).count(w) for f, k in S.WEIGHTS.items()))} for w in S.query_words(query)}
    out = []
    for i, e in enumerate(entities):
        if (query.strip().lower() in text(e) or query.strip() in ("", "*")) and (not types or e["entity_type"] in types) and (not platforms or e["platform"] in platforms):
            length = sum(len(said(e[f])) for f in S.WEIGHTS)
            score = sum(math.log(1 + (n - len(m) + .5) / (len(m) + .5)) * m[i] * 2.2 / (m[i] + 1.2 * (.25 + .75 * length / (total / n)))
                        for m in tf.values() if i in m)
            out.append((-round(score, 6), e["entity_urn"], e["entity_type"]))
    return [(urn_, kind, -s) for s, urn_, kind in sorted(out)]


ALL = ["DATASET", "DOMAIN", "TAG", "CORP_USER", "CORP_GROUP"]


@pytest.mark.parametrize("query", ["abc", "cabc", "abcabca", "ababa", "orders", "daily orders", "Orders D", "ers_da", "ab", "b", "*", "", "ümläut s", "nowhere",
                                   "dataplatform:snowflake,db.orders", "..."])
def test_search_equals_a_scan(index, query):
    index, entities = index
    for types, platforms in ((None, None), (["DATASET"], ["p1"]), (["TAG", "DOMAIN"], None))[:3 if query in ("orders", "ab") else 1]:
        got = [(r.entity_urn, r.entity_type, r.score) for r in S.ranked(index, query, types or ALL, platforms).orderBy("position").collect()]
        want = brute(entities, query, types, platforms)
        assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6)


def test_datasets_unless_named_and_the_best_few(index):
    index, entities = index
    want = [w[0] for w in brute(entities, "orders", ["DATASET"])]
    assert [r.entity_urn for r in S.ranked(index, "orders").orderBy("position").collect()] == want
    assert [r.entity_urn for r in S.ranked(index, "orders", count=2).orderBy("position").collect()] == want[:2]


def test_only_the_querys_buckets_are_read(index):
    index, _ = index
    df = index.postings("grams", "gram", ["abc"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert {r.bucket for r in df.select("bucket").distinct().collect()} == {S._bucket("abc", 5)}
    assert "gram" in plan.split("PushedFilters:")[1].split("]")[0]
    assert S.pieces("abcdefgh") == [("abc", 0), ("def", 3), ("fgh", 5)] and S.pieces("abc") == [("abc", 0)]


def test_an_empty_catalogue(spark):
    index = S.build_index(catalog(spark, []), buckets=2)
    assert S.ranked(index, "orders").count() == 0 and S.ranked(index, "*").count() == 0
