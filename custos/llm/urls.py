"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A short set of rules (host, path) judges first: a rule fits its host and all subdomains if the URL's path
starts with the rule's, and the longest fitting rule wins (of equal length the one with the longer host). URLs
that no rule fits are judged by the list: they are put into a canonical form, and those whose bits are all set in
the filter go to a join with the list itself, which removes the false positives. Listed URLs are blocked, all
others allowed, so the filter decides nothing by itself: it keeps most rows out of the exact join.

The filter is a table of 256-bit blocks, four 64-bit words each. A URL's first hash names its block, its second
sets eight bits there, two a word; ``bit_or`` builds all blocks at once with map-side aggregation. A probe costs
one look-up of one block. The size follows the list (``BITS`` bits a URL): below ``BROADCAST_BYTES`` the blocks are
broadcast, beyond they are shuffle-joined by block, with rows on one side and one row a block on the other, so that
hot URLs split. The list is broadcast under the same bound on the bytes of its texts.

DataFrame expressions only.

Rows: a null URL, or one without ``://``, has empty host and path, fits no rule with a host and is on no list, so it
is allowed. Every row of the input stays, equal rows included, with all its columns; the new columns get other
names if the input has these already (``scratch.fresh``). An empty list blocks nothing.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custos.llm.scratch import Scratch, fresh, packed_rest

BITS = 16  # bits of the filter for each listed URL
BLOCK_BITS = 256
BLOCK_BYTES = 64  # a row (number and four words), generously
BROADCAST_BYTES = 32 << 20
MAX_RULES = 256
WORDS = ["w0", "w1", "w2", "w3"]
# Parameters of a query that follow a reader about and don't name another page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for URLs of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: str | Column) -> Column:
    """One text for all spellings of a page's address: no scheme, default port, ``www.``, fragment, closing slash,
    index or html ending, no tracking parameters, the other parameters in order. Null without ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"(/index\.html?|\.html?|/)$", "")
    query = F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&")
    query = F.array_sort(F.filter(query, lambda q: (q != "") & ~q.rlike(TRACKING)))
    text = F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    url = F.col(url) if isinstance(url, str) else url
    return F.when(url.contains("://"), text)


def _bits(key: Column) -> list[Column]:
    """The words with a URL's eight bits: two in each, from its second hash."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("bigint"),
                                     F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(12 * i).bitwiseOR(bit(12 * i + 6)) for i in range(len(WORDS))]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def bloom(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, w0 .. w3): the filter of the column ``key`` in ``n_blocks`` blocks; blocks without a bit have no row."""
    marked = listed.select(_block(F.col(key), n_blocks).alias("block"), *[b.alias(w) for w, b in zip(WORDS, _bits(F.col(key)), strict=True)])
    return marked.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def possible(rows: DataFrame, key: str, blocks: DataFrame, n_blocks: int, flag: str) -> DataFrame:
    """``rows`` with ``flag``: may ``key`` (not null) be in the filter? No listed key is ever refused."""
    blocks = blocks.withColumnsRenamed({"block": "_block", **{w: f"_{w}" for w in WORDS}})
    met = rows.join(blocks, _block(F.col(key), n_blocks) == F.col("_block"), "left")
    hit = F.lit(True)
    for w, bits in zip(WORDS, _bits(F.col(key)), strict=True):
        hit = hit & (F.col(f"_{w}").bitwiseAND(bits) == bits)
    return met.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(*blocks.columns)


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, url: str = "url") -> DataFrame:
    """The rows of ``pages`` with host, path, rule (the deciding rule's host and path, or null) and verdict.

    ``rules`` is a short list (at most ``MAX_RULES``: they become one expression); ``listed`` has one column of URLs
    in any spelling, any number, repeats and nulls allowed."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules; more belong in the list")
    host, path = host_of("_url"), path_of("_url")
    order = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    first = lambda name: F.coalesce(*[F.when(r.fits(F.col("_host"), F.col("_path")), F.lit(getattr(r, name))) for r in order],
                                    F.lit(None).cast("string"))
    with Scratch(pages.sparkSession) as s:
        known = s.table(listed.select(canonical(listed.columns[0]).alias("_listed")).where("_listed is not null").distinct(), keep=True)
        n, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_listed") + 32), F.lit(0))).first()
        n_blocks = max(1, math.ceil(n * BITS / BLOCK_BITS))
        blocks = s.table(bloom(known, "_listed", n_blocks), keep=True)
    if n_blocks * BLOCK_BYTES <= BROADCAST_BYTES:
        blocks = F.broadcast(blocks)
    if size <= BROADCAST_BYTES:
        known = F.broadcast(known)
    rows = pages.select(packed_rest(pages, pages.columns).alias("_row"), packed_rest(pages, [url])[url].alias("_url"))
    rows = rows.select("_row", "_url", host.alias("_host"), path.alias("_path")).select(
        "*", first("text").alias("_rule"), first("verdict").alias("_verdict"))
    rows = rows.withColumn("_key", F.when(F.col("_rule").isNull(), canonical("_url"))).drop("_url")
    with Scratch(pages.sparkSession) as s:
        rows = s.table(rows, keep=True)  # read three times
    done = ["_row", "_host", "_path", "_rule"]
    ruled = rows.where("_key is null").select(*done, F.coalesce("_verdict", F.lit("allow")).alias("_verdict"))
    open_ = possible(rows.where("_key is not null"), "_key", blocks, n_blocks, "_possible")
    absent = open_.where("not _possible").select(*done, F.lit("allow").alias("_verdict"))
    met = open_.where("_possible").join(known, F.col("_key") == F.col("_listed"), "left").select(
        *done, F.when(F.col("_listed").isNotNull(), F.lit("block")).otherwise(F.lit("allow")).alias("_verdict"))
    out = ruled.unionByName(absent).unionByName(met)
    names = fresh(pages, "host", "path", "rule", "verdict")
    return out.select(*[F.col("_row")[c].alias(c) for c in pages.columns],
                      *[F.col(f"_{c}").alias(name) for c, name in zip(("host", "path", "rule", "verdict"), names, strict=True)])
