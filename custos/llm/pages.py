"""Main-text extraction from HTML by a linear-chain CRF over the leaf blocks of the page.

A page is parsed once, tag by tag, with the usual forgiveness (unclosed and stray
tags, implied ends of paragraphs, list items and cells, raw script and style
text, drawings, truncated pages; formulas and embedded objects are text like any other). A leaf block is the text between two boundaries of
block-level elements, with its character references decoded and its white space
turned into single spaces. The blocks of a page, in order, are a chain with two
labels, main text or not. Features are the tags and the words of class, id and
role of all ancestors, the innermost tags, and figures of the text (length, share
of linked text, sentence end, digits, marks); transitions between labels are
learned. Training is maximum likelihood by forward-backward on labelled pages;
a page is decoded by Viterbi. Main blocks are joined in page order by two line feeds.

``labelled_pages`` builds the labelled pages: site layouts of common kinds, put
together at random, with main text marked by construction. Any other list of
(html, labels) can be given to ``fit``. The model is a small dictionary, sent with the task.

Rows: null or empty html, and pages without main text, give an empty text; every row stays.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custos.llm.language import marginals
from custos.llm.scratch import map_arrow

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_NAME = re.compile(r"[a-z]+")
_BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
 figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre
 section select summary table tbody td tfoot th thead title tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "template", "iframe", "svg")}
_OPEN_VALUE = re.compile(r"=\s*[^\s\"'>]+\Z")  # a slash after this is part of an unquoted value
# an opening tag ends an open element of these kinds, not looking past the containers
_ENDS = {**{t: ({"p"}, {"body", "article", "section", "div", "td", "li", "button"}) for t in _BLOCK},
         "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
         "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr", "td", "th"}, {"table"}),
         "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}


MADE = 2000  # sets of features remembered for a page


@dataclass
class Block:
    path: tuple[str, ...]  # features of the ancestors: their tags, words of their attributes, the innermost block tags
    text: str
    linked: int   # characters inside links
    main: bool    # only in labelled pages: inside an element marked data-main


@dataclass(slots=True)
class _Element:
    """An open element. ``features`` are those of it and its ancestors, shared with its parent if it adds none."""

    tag: str
    features: frozenset[str]
    main: bool


class _Open:
    """The open elements, innermost last; for each tag, and for block elements, where they lie, so that no step walks the stack."""

    def __init__(self, known: frozenset[str] | None):
        self.known = known
        self.stack: list[_Element] = []
        self.at: dict[str, list[int]] = {}
        self.block_at: list[int] = []
        self.made: dict[tuple, frozenset[str]] = {}  # of an element's parent, tag and names, as these return

    def push(self, tag: str, names: list[str], main: bool | None) -> None:
        top = self.stack[-1] if self.stack else None
        have = top.features if top else frozenset()
        key = (have, tag, *names)
        features = self.made.get(key)
        if features is None:
            new = [f for f in (f"in {tag}", *(f"named {w}" for w in names)) if f not in have and (self.known is None or f in self.known)]
            features = have.union(new) if new else have
            if len(self.made) < MADE:
                self.made[key] = features
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in _BLOCK:
            self.block_at.append(len(self.stack))
        self.stack.append(_Element(tag, features, (top.main if top else False) if main is None else main))

    def cut(self, i: int) -> None:
        """Element ``i`` and all inside it end."""
        for e in reversed(self.stack[i:]):
            self.at[e.tag].pop()
            if e.tag in _BLOCK:
                self.block_at.pop()
        del self.stack[i:]

    def nearest(self, tags) -> int:
        """The place of the innermost open element of these tags, or -1."""
        best, at = -1, self.at
        for t in tags:
            places = at.get(t)
            if places and places[-1] > best:
                best = places[-1]
        return best

    def path(self) -> tuple[str, ...]:
        if not self.stack:
            return ("leaf ",)
        own = [self.stack[i].tag for i in self.block_at[-2:]]
        return (*self.stack[-1].features, *dict.fromkeys((f"leaf {'/'.join(own[-1:])}", f"leaf {'/'.join(own)}")))


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page in order; with ``known`` only these features of ancestors are kept, so that a block takes no
    more than a model has, however deep it lies. Time and memory are linear in the page."""
    out: list[Block] = []
    open_ = _Open(known)
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split()) if pieces else ""
        if text:
            out.append(Block(open_.path(), text, linked, bool(open_.stack) and open_.stack[-1].main))
        pieces.clear()
        linked = 0

    def read(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            pieces.append(text)
            if open_.at.get("a"):
                linked += len(text.strip())

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            read(page[at:])
            break
        read(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in _BLOCK:
                flush()
            i = open_.nearest((tag,))
            # the end of an inline element doesn't end blocks
            if i >= 0 and (tag in _BLOCK or not open_.block_at or open_.block_at[-1] < i):
                open_.cut(i)
            continue
        if tag == "br":
            pieces.append(" ")
        if tag in ("svg", "math") and m[3].endswith("/") and not _OPEN_VALUE.search(m[3]):
            continue  # embedded XML: the slash ends the element
        if tag in _RAW:
            close = _RAW[tag].search(page, at)
            # a drawing that is never closed does not take the rest of the page with it
            at = close.end() if close else at if tag == "svg" else end
            continue
        if tag in _BLOCK:
            flush()
            which, inside = _ENDS[tag]
            i = open_.nearest(which)
            if i >= 0 and i > open_.nearest(inside - which):
                open_.cut(i)
        if tag not in _VOID:  # a slash at the end of other tags means nothing
            names = [w for a in _ATTRIBUTE.finditer(m[3]) for w in _NAME.findall((a[2] or a[3] or a[4] or "").lower())]
            open_.push(tag, names, True if "data-main" in m[3] else False if "data-not" in m[3] else None)
    flush()
    return out


def features(b: Block) -> list[str]:
    words, text = b.text.count(" ") + 1, b.text
    share = b.linked / max(len(text), 1)
    return [*b.path, "any", f"words {min(words.bit_length(), 6)}", f"linked {min(int(share * 3), 2)}",
            f"end {text[-1] if text[-1] in '.!?:…»”' else '-'}",
            *(["mark"] if any(c in text for c in "©®|»›") else []),
            *(["digits"] if sum(map(str.isdigit, text)) * 4 > len(text) else [])]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # for main against not
    transition: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    @cached_property
    def known(self) -> frozenset[str]:
        return frozenset(self.weights)

    def labels(self, chain: list[Block]) -> list[bool]:
        """Viterbi: the likeliest labels of a page's blocks."""
        (nn, nm), (mn, mm) = self.transition
        no, yes, back = 0.0, 0.0, []
        for b in chain:
            e = sum(self.weights.get(f, 0.0) for f in features(b))
            from_no, from_yes = no + nm < yes + mm, no + nn < yes + mn
            back.append((from_yes, from_no))  # the label before, if this one is not / is main
            no, yes = max(no + nn, yes + mn), max(no + nm, yes + mm) + e
        out, now = [], yes > no
        for not_main, main in reversed(back):
            out.append(now)
            now = main if now else not_main
        return out[::-1]

    def text(self, page: str | None) -> str:
        chain = blocks(page or "", self.known)
        return "\n\n".join(b.text for b, main in zip(chain, self.labels(chain), strict=True) if main)


def fit(pages: list[str], steps: int = 250, rate: float = 0.1, ridge: float = 5e-5) -> Model:
    """Maximum likelihood on pages whose main text is marked by data-main (and data-not inside it)."""
    chains = [c for c in map(blocks, pages) if c]
    names: dict[str, int] = {}
    rows = [[names.setdefault(f, len(names)) for f in features(b)] for c in chains for b in c]
    y = np.array([b.main for c in chains for b in c], int)
    bounds = np.concatenate(([0], np.cumsum([len(c) for c in chains])))
    owner, column = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    theta = [np.zeros(len(names)), np.zeros((2, 2))]
    mean, var = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    inner = np.ones(len(y), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    for it in range(1, steps + 1):
        e = np.bincount(owner, theta[0][column], len(y))
        p, joint, _ = marginals(np.stack([np.zeros_like(e), e], 1), bounds, theta[1])
        np.add.at(joint, (y[at - 1], y[at]), -1)
        grad = [np.bincount(column, (p[:, 1] - y)[owner], len(names)) / len(y) + ridge * theta[0], joint / len(y) + ridge * theta[1]]
        for x, g, m, v in zip(theta, grad, mean, var, strict=True):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            x -= rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.98**it)) + 1e-8)
    (a, b), (c, d) = theta[1].tolist()
    return Model({f: float(theta[0][i]) for f, i in names.items()}, ((a, b), (c, d)))


# Kinds of page parts: {s} a sentence, {w} a word or two, {p} a paragraph. Several words in a class are alternatives' names.
_AROUND = {
    "top": ['<header class="site header masthead"><a href="/">{w}</a><p>{s}</p></header>', '<div id="header" class="topbar"><h1>{w}</h1><p>{s}</p></div>',
            "<header><h1>{w}</h1><h2>{s}</h2></header>", '<div class="header banner">{s}</div>', ""],
    "menu": ['<nav><ul><li><a href="/">{w}</a></li><li><a href="/a">{w}</a></li><li><a href="/b">{w}</a></li></ul></nav>',
             '<ul class="menu navigation nav navbar"><li><a href="/">{w}</a></li><li><a>{w}</a></li></ul>',
             '<div class="breadcrumb breadcrumbs"><a href="/">{w}</a> &raquo; <a href="/x">{w}</a></div>',
             '<div role="navigation" id="menu"><a href="/">{w}</a> | <a href="/y">{w}</a></div>', "<nav><a>{w}</a><p>{s}</p></nav>", ""],
    "advert": ['<div class="ad">{s}</div>', '<div class="ad">{s} {s} {s}</div>', '<div class="ads advert advertisement">{s}</div>',
               '<div id="sponsored" class="promo"><p>{s}</p></div>', '<aside class="advert"><a href="//x">{s}</a></aside>', '<section class="sponsor promotion"><p>{p}</p></section>', ""],
    "notice": ['<div class="cookie notice consent"><p>{s}</p><button>{w}</button></div>', '<div role="alert" class="banner notice alert">{s}</div>',
               '<dialog class="modal popup overlay"><p>{s}</p></dialog>', '<div class="newsletter subscribe signup"><p>{p}</p></div>', '<div id="gdpr" class="cookies privacy"><p>{p}</p></div>', "<noscript>{s}</noscript>", ""],
    "side": ["<aside><h3>{w}</h3><ul><li><a>{s}</a></li><li><a>{s}</a></li></ul></aside>", '<div class="sidebar widget"><h4>{w}</h4><p>{s}</p></div>',
             '<div id="related" class="related recommended"><h3>{w}</h3><p><a href="/r">{s}</a></p></div>', "<aside><p>{p}</p></aside>", '<div class="side column teaser popular trending"><p>{s}</p></div>', '<div class="share social tags"><a>{w}</a> <a>{w}</a></div>', ""],
    "form": ['<form action="/s"><label>{w}</label><input name="q"><button>{w}</button></form>', '<form class="search"><p>{s}</p><select><option>{w}</option><option>{w}</option></select></form>',
             '<div class="login contact"><form><fieldset><legend>{w}</legend><p>{s}</p><textarea>{s}</textarea></fieldset></form></div>', ""],
    "comments": ['<section id="comments"><h2>{w}</h2><div class="comment"><p>{p}</p></div><div class="comment"><p>{s}</p></div></section>',
                 '<div class="comments discussion responses replies"><article class="comment"><header>{w}</header><p>{p}</p></article></div>',
                 '<ol class="commentlist"><li class="comment reply"><p>{p}</p></li></ol>', '<div id="disqus" class="reader user comments"><h3>{w}</h3><p>{p}</p><p>{s}</p></div>', ""],
    "bottom": ["<footer>&copy; {w}.example.com &middot; {s}</footer>", '<footer><p>{s}</p><ul><li><a>{w}</a></li></ul></footer>',
               '<div id="footer" class="footer"><p>&copy; 2020 {w}. {s}</p></div>', '<div class="copyright legal bottom">{s}</div>', '<footer class="site"><p>{p}</p></footer>', ""],
}
_MAIN = [("<article data-main>", "</article>"), ("<main data-main>", "</main>"), ("<main><article data-main>", "</article></main>"),
         ('<div class="content article post body entry" data-main>', "</div>"), ('<div id="content" data-main>', "</div>"), ('<div id="main"><div class="story text" data-main>', "</div></div>"),
         ('<section class="article content" data-main>', "</section>"), ("<div><div data-main>", "</div></div>"), ('<article class="post" data-main>', "</article>"), ("<article data-main>", "</article>"), ("<article data-main>", "</article>")]
_PARTS = ["<p>{p}</p>"] * 8 + ["<p>{s}</p>", "<p>{s}", "<p>{w}.</p>", "<p><b>{s}<br><p>{p}</p>", "<p><b>{w}</b> {s} <a href='/l'>{w}</a> {s}</p>", "<h2>{w}</h2><p>{p}</p>", "<h3>{s}</h3>",
                               "<ul><li>{s}</li><li>{s}</li><li>{w}</li></ul>", "<ol><li>{s}</li><li>{w}</li></ol>", "<blockquote><p>{s}</p></blockquote>", "<pre>{s}</pre>", "<table><tr><th>{w}</th><td>{w}</td></tr><tr><td>{s}</td><td>{w}</td></tr></table>",
                               "<figure><img src=x><figcaption>{s}</figcaption></figure>", "<dl><dt>{w}</dt><dd>{s}</dd></dl>", "<div>{p}</div>", "<section><h2>{w}</h2><p>{p}</p></section>"]
_TITLE = ["<h1>{w}</h1>", "<h1>{s}</h1>", "<h1>{s}</h1>", "<header><h1>{s}</h1></header>", "<h1>{s} {s}</h1>", ""]


def labelled_pages(n: int = 600, seed: int = 5) -> list[str]:
    """``n`` pages put together from the parts above; data-main marks their main text."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda x: x[int(rng.integers(len(x)))]
    syllables = "ba de ki lo mu ran sen tir von wal é ü ço".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    sentence = lambda: " ".join(word() for _ in range(int(rng.integers(2, 14)))).capitalize() + pick([".", ".", ".", ",", "!", "?", ""])

    def fill(part: str) -> str:
        part = re.sub(r"\{p\}", lambda _: " ".join(sentence() for _ in range(int(rng.integers(2, 7)))), part)
        part = re.sub(r"\{s\}", lambda _: sentence(), part)
        return re.sub(r"\{w\}", lambda _: " ".join(word() for _ in range(int(rng.integers(1, 3)))).capitalize(), part)

    out = []
    for _ in range(n):
        some = lambda *kinds: "".join(fill(pick(_AROUND[k])) for k in kinds)
        start, stop = pick(_MAIN)
        inside = [fill(pick(_PARTS)) for _ in range(int(rng.integers(1, 14)))]
        for _ in range(int(rng.integers(0, 4))):  # what doesn't belong to the text lies in its midst too
            part = fill(pick(_AROUND[pick(["advert", "side", "notice", "comments", "form"])]))
            inside.insert(int(rng.integers(len(inside) + 1)), re.sub(r"^<(\w+)", r"<\1 data-not", part))
        end = pick(["</body></html>", "</body></html>", "</html>", ""])
        out.append(f"<!DOCTYPE html><html><head><title>{sentence()}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
                   + some("notice", "top", "menu", "advert", "side") + start + fill(pick(_TITLE)) + "".join(inside) + stop
                   + some("advert", "side", "form", "comments", "notice", "bottom") + end)
    return out


def _extract(model: Model):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [model.text(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64()), *batch.columns[1:]],
                names=["text", "n_chars", *batch.schema.names[1:]])
    return extract


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    model = model or fit(labelled_pages())
    one = pages.select("html", F.struct("page_id", "url").alias("row"))
    out = map_arrow(one, _extract(model), "text string, n_chars bigint", "row")
    return out.select("row.page_id", "row.url", "text", "n_chars")
