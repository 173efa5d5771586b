"""Fill-in-middle by secondary sort: pieces of documents, sorted by place, streamed into digests or texts.

A document's units (lines, words or characters) are cut at two seeded places into prefix, middle and suffix, and
rearranged with markers: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` <S>suffix<P>prefix<M>middle, ``plain`` the text as
it is. No text is ever put together to be hashed: each part is emitted as *pieces*, runs of whole units of about
``CHUNK`` bytes (a longer unit is cut), keyed by document and output position. One shuffle by document with a sort inside the
partitions (``repartition`` + ``sortWithinPartitions``) brings them into output order, and a task streams them into an incremental
digest, piece by piece, whatever the length of the document. The same rows are then sorted again inside their partitions, by the
position in the original text that markers and form give them, and streamed into the digest of the restored text.

A document is a row of the input: rows are told apart by their place in it (``monotonically_increasing_id``), so that repeated
or missing ids gather nowhere. The input must therefore come in the same order when a lost task is run again, as a read of
files does; write any other frame to a table first.

Rows: a null text is empty; an empty text, one that holds a marker, and the share ``100 - percent`` stay plain. A missing
doc_id is hashed as the empty text, so such rows are cut at places of one draw. Every row stays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custos.llm.scratch import fresh, map_arrow, packed_rest

MARKS = ("<P>", "<S>", "<M>")
UNITS = {"line": rb"[^\n]*\n|[^\n]+", "word": rb"[^ ]* |[^ ]+", "char": rb"[\x00-\x7F]|[\xC0-\xFF][\x80-\xBF]*"}
# Order of the parts in the output, by form, and in the restored text.
ORDERS = {"psm": "PSM", "spm": "SPM"}
RESTORED = "PMS"
CHUNK = 1 << 16  # bytes of a piece
BATCH = 1 << 23  # bytes of an Arrow batch of pieces

_CONTINUED = bytes(range(0x80, 0xC0))  # bytes that begin no code point
_FACTS = "n bigint, form string, prefix_chars bigint, middle_chars bigint"
_PIECES = f"row bigint, place bigint, data binary, {_FACTS}"
_STREAMED = f"{_PIECES}, output_sha256 string"
_TEXTS = f"row bigint, text binary, {_FACTS}, output_sha256 string"
_DIGESTS = f"row bigint, {_FACTS}, output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Plan:
    """How documents are cut: unit, share of rearranged ones, share of spm among these, and the seed of all draws."""

    unit: str = "line"
    percent: int = 100
    spm_percent: int = 50
    seed: str = "7"
    chunk: int = CHUNK
    pattern: re.Pattern = field(init=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "pattern", re.compile(UNITS[self.unit]))

    def draws(self, doc_id: int | str | None) -> list[int]:
        h = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(h[i:i + 8], 16) for i in range(0, 32, 8)]

    def ends(self, text: bytes) -> list[int]:
        """Byte offsets of the units' ends."""
        return [m.end() for m in self.pattern.finditer(text)]

    def chunks(self, text: bytes, ends: list[int], first: int, last: int) -> list[bytes]:
        """The units first .. last - 1 in runs of whole units of at most ``chunk`` bytes; longer units are cut.
        At least one piece, if an empty one."""
        at, hi = (ends[first - 1] if first else 0), (ends[last - 1] if last else 0)
        if hi - at <= self.chunk:
            return [text[at:hi]]
        out, whole = [], at  # whole: end of the units that still fit
        for end in ends[first:last]:
            if end - at > self.chunk:
                if whole > at:
                    out.append(text[at:whole])
                    at = whole
                while end - at > self.chunk:
                    out.append(text[at:at + self.chunk])
                    at += self.chunk
            whole = end
        return [*out, text[at:hi]]

    def cut(self, text: bytes, doc_id: int | str | None) -> tuple[tuple, list[bytes]]:
        """(n, form, prefix_chars, middle_chars) and the pieces of the output; each part begins a piece, after its marker."""
        h1, h2, h3, h4 = self.draws(doc_id)
        ends = self.ends(text)
        n = len(ends)
        if not text or h3 % 100 >= self.percent or any(m.encode() in text for m in MARKS):
            return (n, "plain", None, None), self.chunks(text, ends, 0, n)
        form = "spm" if h4 % 100 < self.spm_percent else "psm"
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        part = {"P": self.chunks(text, ends, 0, a), "M": self.chunks(text, ends, a, b), "S": self.chunks(text, ends, b, n)}
        chars = {name: sum(len(x.translate(None, _CONTINUED)) for x in part[name]) for name in "PM"}
        data = []
        for name in ORDERS[form]:
            first, *more = part[name]
            data += [f"<{name}>".encode() + first, *more]
        return (n, form, chars["P"], chars["M"]), data


class Rows:
    """Rows gathered for an Arrow batch; ``rest`` are one-row slices of an Arrow column, or None."""

    def __init__(self, schema: list[tuple[str, pa.DataType]], rest: pa.DataType):
        self.schema, self.kind, self.rows, self.rest, self.size = schema, rest, [], [], 0

    def add(self, row: tuple, rest: pa.Array | None = None, size: int = 0) -> None:
        self.rows.append(row)
        self.rest.append(rest)
        self.size += size

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(self.schema)
        given = [x for x in self.rest if x is not None]
        at, n = [], 0
        for x in self.rest:
            at.append(None if x is None else n)
            n += x is not None
        rest = (pa.concat_arrays(given) if given else pa.array([], self.kind)).take(pa.array(at, pa.int64()))
        made = pa.RecordBatch.from_arrays(
            [*[pa.array(c, kind) for c, (_, kind) in zip(columns, self.schema, strict=True)], rest],
            names=[*[name for name, _ in self.schema], "rest"])
        self.rows, self.rest, self.size = [], [], 0
        return made


_KINDS = {"data": pa.binary(), "text": pa.binary(), "form": pa.string(), "output_sha256": pa.string(), "restored_sha256": pa.string()}


def _rows(ddl: str, batch: pa.RecordBatch) -> Rows:
    names = [c.split()[0] for c in ddl.split(", ")]
    return Rows([(c, _KINDS.get(c, pa.int64())) for c in names], batch.column("rest").type)


def _pieces(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, doc_id, row, rest) to ``_PIECES`` in output order; the first piece of a document has its facts and its rest."""
    for batch in batches:
        out = _rows(_PIECES, batch)
        for i, (text, doc_id, row) in enumerate(zip(batch.column("text"), batch.column("doc_id"), batch.column("row"), strict=True)):
            facts, data = plan.cut((text.as_py() or "").encode(), doc_id.as_py())
            row = row.as_py()
            out.add((row, 0, data[0], *facts), batch.column("rest").slice(i, 1), len(data[0]))
            for place, d in enumerate(data[1:], 1):
                out.add((row, place, d, None, None, None, None), None, len(d))
            if out.size > BATCH:
                yield out.batch()
        yield out.batch()


def _documents(batches: Iterator[pa.RecordBatch], facts: list[str]) -> Iterator[tuple]:
    """Sorted rows as ("new", row, facts, rest), ("piece", row, data, None) and, after each document, ("end", row, None, None);
    ("batch", None, None, None) after each batch."""
    row = None
    for batch in batches:
        known = list(zip(*[batch.column(c).to_pylist() for c in facts], strict=True))
        for i, (r, f, data) in enumerate(zip(batch.column("row").to_pylist(), known, batch.column("data"), strict=True)):
            if r != row:
                if row is not None:
                    yield "end", row, None, None
                yield "new", r, f, batch.column("rest").slice(i, 1)
                row = r
            if data.is_valid:
                yield "piece", r, data.as_py(), None
        yield "batch", None, None, None
    if row is not None:
        yield "end", row, None, None
        yield "batch", None, None, None


def _peek(batches: Iterator[pa.RecordBatch]) -> tuple[pa.RecordBatch | None, Iterator[pa.RecordBatch]]:
    first = next(batches, None)
    return first, iter(()) if first is None else _chain(first, batches)


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


_FACT_NAMES = ["n", "form", "prefix_chars", "middle_chars"]


def _output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in output order to the same pieces at their places in the original text, without markers; each document's facts
    and the digest of its output go to a row at place -1."""
    first, batches = _peek(batches)
    if first is None:
        return
    out = _rows(_STREAMED, first)
    for what, row, x, more in _documents(batches, _FACT_NAMES):
        if what == "new":
            facts, rest, digest, part, count = x, more, hashlib.sha256(), 0, 0
        elif what == "piece":
            digest.update(x)
            # only a part's first piece begins with a marker: such texts hold none themselves
            if facts[1] != "plain" and x[:3].decode("latin-1") in MARKS:
                part, x = RESTORED.index(x[1:2].decode()), x[3:]
            out.add((row, (part << 40) + count, x, None, None, None, None, None))
            count += 1
        elif what == "end":
            out.add((row, -1, None, *facts, digest.hexdigest()), rest)
        else:
            yield out.batch()


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of the original text, each document led by its facts, to ``_DIGESTS``."""
    first, batches = _peek(batches)
    if first is None:
        return
    out = _rows(_DIGESTS, first)
    for what, row, x, more in _documents(batches, [*_FACT_NAMES, "output_sha256"]):
        if what == "new":
            facts, rest, digest = x, more, hashlib.sha256()
        elif what == "piece":
            digest.update(x)
        elif what == "end":
            out.add((row, *facts, digest.hexdigest()), rest)
        else:
            yield out.batch()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in output order to ``_TEXTS``: a document's output in one row, as its text was."""
    first, batches = _peek(batches)
    if first is None:
        return
    out = _rows(_TEXTS, first)
    for what, row, x, more in _documents(batches, _FACT_NAMES):
        if what == "new":
            facts, rest, parts = x, more, []
        elif what == "piece":
            parts.append(x)
        elif what == "end":
            text = b"".join(parts)
            out.add((row, text, *facts, hashlib.sha256(text).hexdigest()), rest, len(text))
            if out.size > BATCH:
                yield out.batch()
        else:
            yield out.batch()


def _sorted_pieces(docs: DataFrame, plan: Plan, keep: list[str]) -> DataFrame:
    """All pieces, a document's in one partition and in output order."""
    rows = docs.select("text", "doc_id", F.monotonically_increasing_id().alias("row"), packed_rest(docs, keep).alias("rest"))
    # of a type that may be null, as the column is after a document's first piece
    rows = rows.withColumn("rest", F.when(F.col("row") >= 0, F.col("rest")))
    return map_arrow(rows, partial(_pieces, plan), _PIECES, "rest").repartition("row").sortWithinPartitions("row", "place")


def digests(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row of ``docs`` (doc_id, text):
    units, form, code points of two parts (null if plain), digests of the rearranged text and of the text restored from it."""
    streamed = map_arrow(_sorted_pieces(docs, plan, ["doc_id"]), _output, _STREAMED, "rest")
    out = map_arrow(streamed.sortWithinPartitions("row", "place"), _restored, _DIGESTS, "rest")
    return out.select("rest.doc_id", *_FACT_NAMES, "output_sha256", "restored_sha256")


def transform(docs: DataFrame, plan: Plan) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, any others) with the rearranged text in ``text``, and its form."""
    keep = [c for c in docs.columns if c != "text"]
    form, = fresh(docs, "form")
    out = map_arrow(_sorted_pieces(docs, plan, keep), _joined, _TEXTS, "rest")
    return out.select(*[F.col("text").cast("string").alias(c) if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns],
                      F.col("form").alias(form))


def restored(text: Column, form: Column) -> Column:
    """The original of a rearranged text, by its markers."""
    part = lambda after, before: F.substring_index(F.substring_index(text, after, -1), before, 1)
    whole = F.when(form == "psm", F.concat(part("<P>", "<S>"), part("<M>", "<M>"), part("<S>", "<M>")))
    return whole.when(form == "spm", F.concat(part("<P>", "<M>"), part("<M>", "<M>"), part("<S>", "<P>"))).otherwise(text)
