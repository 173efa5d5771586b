"""URL filter: rules and list against a plain version; the Bloom filter refuses no listed URL and few others."""

import re

import pytest
from pyspark.sql import functions as F

from custos.llm import urls as U

RULES = [U.Rule("allow", "com", "/"), U.Rule("block", "example.com", "/en/"), U.Rule("allow", "www.example.com", "/en/"), U.Rule("block", "net", "/es/")]
URLS = ["http://example.com/en/1", "https://WWW.Example.COM/en/1", "http://notexample.com/en/", "http://a.b.example.com/en/x", "http://com", "http://com/",
        "http://xcom/", "ftp://x.net/es/", "x.net/es/", "http://x.net/fr?/es/", "http://x.net?q=/es/", "http://x.net#/es/", "://net/es/", "", None, "http://",
        "http://bad.org/a/", "https://www.bad.org:443/a?utm_source=x#top", "http://bad.org/a.html?ref=1", "http://bad.org/b", "http://bad.org/a?b=2&a=1",
        "http://bad.org/a?a=1&b=2", "http://É.org/ü\nx", "http://user@bad.org/a", "http://x://net/es/"]
LISTED = ["http://BAD.org/a", None, "nothing", "http://bad.org/a?a=1&b=2", "http://bad.org/a", "http://example.com/en/1"]


def split(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host = m.group(2) if m else ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), m.group(3) if m else ""


def canonical(url):
    if url is None or "://" not in url:
        return None
    host, path = split(url)
    query = url.split("#")[0].partition("?")[2].split("&")
    query = sorted(q for q in query if q and not re.match(r"(utm_[^=]*|ref|fbclid|gclid)(=|$)", q))
    return re.sub(r"^www\.", "", re.sub(r":(80|443)?$", "", host)) + re.sub(r"(/index\.html?|\.html?|/)$", "", path) + ("?" + "&".join(query) if query else "")


def brute(url, rules, listed):
    host, path = split(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)
    if best:
        return host, path, best.text, best.verdict
    known = {canonical(x) for x in listed} - {None}
    return host, path, None, "block" if canonical(url) in known else "allow"


@pytest.mark.parametrize("bound", [U.BROADCAST_BYTES, 0])
def test_judged_as_a_plain_version_does(spark, monkeypatch, bound):
    """With the filter and list broadcast, and with both shuffle-joined."""
    monkeypatch.setattr(U, "BROADCAST_BYTES", bound)
    pages = spark.createDataFrame(list(enumerate(URLS * 3)), "page_id bigint, url string")
    listed = spark.createDataFrame([(x,) for x in LISTED], "anything string")
    out = U.judge(pages, RULES, listed).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in out) == sorted(
        (i, h, p, t or "", v) for i, u in enumerate(URLS * 3) for h, p, t, v in [brute(u, RULES, LISTED)])


def test_filter_keeps_listed_and_refuses_most_others(spark):
    listed = spark.range(5000).select(F.concat(F.lit("host/"), "id").alias("k"))
    n_blocks = 5000 * U.BITS // U.BLOCK_BITS
    blocks = U.bloom(listed, "k", n_blocks)
    assert U.possible(listed, "k", blocks, n_blocks, "f").where("f").count() == 5000
    others = spark.range(20_000).select(F.concat(F.lit("other/"), "id").alias("k"))
    assert U.possible(others, "k", blocks, n_blocks, "f").where("f").count() < 400
    assert U.possible(others, "k", blocks.limit(0), n_blocks, "f").where("f").count() == 0


def test_only_possible_rows_reach_the_list(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i}") for i in range(100)], "page_id bigint, url string")
    out = U.judge(pages, [], pages.where("page_id < 0").select("url"))
    assert out.where("verdict = 'allow' and rule is null").count() == 100
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_hard_rows_and_clashing_names(spark, documents, nothing):
    pages = documents.withColumns({"url": F.concat(F.lit("http://x.net/es/"), "doc_id"), "host": F.lit("mine"), "rule": F.lit(1), "_key": F.lit(2)})
    out = U.judge(pages, RULES, pages.select("text"))
    assert out.columns == [*pages.columns, "_host", "path", "_rule", "verdict"] and out.count() == pages.count()
    assert out.where("host = 'mine' and rule = 1 and _key = 2").count() == pages.count()
    assert out.where("url is null").select("_host", "path", "_rule", "verdict").distinct().collect() == [("", "", None, "allow")]
    assert U.judge(nothing.withColumn("url", F.lit("u")), RULES, nothing.select("text")).collect() == []
    with pytest.raises(ValueError):
        U.judge(pages, RULES * 100, pages.select("text"))
