"""Whole Arrow string columns cut into hashed words with numpy, no Python loop per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, as in the
pattern ``[^\\x20\\x09-\\x0D]+``; UTF-8 never uses those bytes inside a
character, so bytes and characters give the same words. Every word gets a
64-bit hash of its bytes: a polynomial over a random byte table (all prefix
sums of a chunk at once), then a finaliser. Sequences of words are hashed the
same way over the word hashes, so any run of words costs two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, dtype=np.uint64)
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and doubled as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 0 if have is None else 2 * len(have))
        have = np.full(size, base, U)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=U)
    return have[:n]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums C with C[j] - C[i] = sum of values[k] * base**k for i <= k < j."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values)), out=out[1:], dtype=U)
    return out


def runs(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of each run [start, end), independent of where the run lies."""
    inverse = powers(pow(base, -1, 1 << 64), len(sums))
    length = (end - start).astype(U)
    return mix((sums[end] - sums[start]) * inverse[start] + length * U(0xA0761D6478BD642F))


@dataclass
class Words:
    """The words of rows ``first`` .. ``first + n_docs - 1`` of a column."""

    first: int
    data: np.ndarray    # the chunk's bytes
    offsets: np.ndarray  # byte offsets of rows, n_docs + 1
    start: np.ndarray   # byte offsets of words
    end: np.ndarray
    hash: np.ndarray    # uint64 of each word
    bounds: np.ndarray  # word offsets of rows, n_docs + 1

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1

    @property
    def doc(self) -> np.ndarray:
        """Row (within the chunk) of each word."""
        return np.repeat(np.arange(self.n_docs), np.diff(self.bounds))

    def sequence_sums(self) -> np.ndarray:
        return prefix(self.hash, _Q)

    def sequences(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return runs(sums, start, end, _Q)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying; null rows are empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def spans(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each (a longer row stands alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(column: pa.Array, lower: bool = False) -> Iterator[Words]:
    """The words of a string column, in chunks of whole rows."""
    raw, off = text_buffers(column)
    for i, j in spans(off):
        b = raw[off[i]:off[j]]
        o = off[i:j + 1] - off[i]
        if lower:
            b = _LOWER[b]
        # a mark between bytes: True where a word may begin or end
        inside = np.zeros(len(b) + 2, bool)
        inside[1:-1] = ~_SPACE[b]
        cut = np.zeros(len(b) + 1, bool)
        cut[o] = True
        start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        sums = prefix(_TABLE[b], _P)
        yield Words(i, b, o, start, end, runs(sums, start, end, _P), np.searchsorted(start, o))


def sliding_min(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum, and its leftmost place, of every ``width`` consecutive values."""
    val, pos, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = val[:-step], val[step:]
        take = left <= right
        val = np.where(take, left, right)
        pos = np.where(take, pos[:-step], pos[step:])
        have += step
    return val, pos


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles, lower-cased
    (A-Z); a row of 1 to k-1 words has its whole sequence as one shingle, a row
    without words (or null) the empty set."""
    for w in words(column, lower=True):
        sums, n = w.sequence_sums(), len(w.hash)
        first = np.arange(n)
        last = w.bounds[1:][w.doc]
        full = first + k <= last
        # a short row contributes its whole sequence once, at its first word
        short = (first == w.bounds[:-1][w.doc]) & ~full
        take = full | short
        first = first[take]
        grams = w.sequences(sums, first, np.minimum(first + k, last[take]))
        edge = np.searchsorted(first, w.bounds)
        for i in range(w.n_docs):
            x = np.sort(grams[edge[i]:edge[i + 1]])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            yield x
