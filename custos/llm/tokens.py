"""Token counts by a linear-time longest-match automaton over a word-piece vocabulary.

Each word (with the vocabulary's word-start mark before it) is cut greedily:
always the longest piece that fits, then on from there. Lengths come without
building pieces from a trie with failure links: every state knows how many
pieces are complete once its next symbol doesn't fit (``pops``) and in which
state the rest of what was read lies (``fail``). So a word costs one step per
byte and one per failure, and nothing is read twice. All single bytes are
pieces (byte fallback), so no word is unknown.

The vocabulary file is read on the driver only; executors get the automaton's
flat arrays (about 2 MB for 32,000 pieces, with the task). Different words of a
chunk run once, side by side, however often they occur.

Rows: null and empty texts have 0 words and 0 tokens; long words and texts are
read whole; every row and column of the input stays.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custos.llm import words as W
from custos.llm.scratch import fresh, map_arrow, packed_rest

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁".encode()  # the vocabulary's mark before the first piece of a word


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a sentencepiece model as UTF-8, without its special and byte entries."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return [model.id_to_piece(i).encode() for i in plain]


@dataclass
class Automaton:
    edges: np.ndarray   # sorted state * 256 + byte
    target: np.ndarray  # state after each edge
    fail: np.ndarray    # state that holds the rest once the pieces before it are popped
    pops: np.ndarray    # how many pieces that pops
    start: int          # state after the word-start mark

    def counts(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Number of pieces of each word data[first:last], all words a step at a time."""
        out = np.zeros(len(first), np.int64)
        live, at, end = np.arange(len(first)), first.astype(np.int64), last.astype(np.int64)
        state = np.full(len(first), self.start, np.int64)
        while len(live):
            more = at < end
            key = (state << 8) | np.where(more, data[np.minimum(at, len(data) - 1)], 0)
            i = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            goes = more & (self.edges[i] == key)
            stays = ~goes
            out[live[stays]] += self.pops[state[stays]]
            at = at + goes
            state = np.where(goes, self.target[i], self.fail[state])
            keep = (at < end) | (state != 0)
            live, at, end, state = live[keep], at[keep], end[keep], state[keep]
        return out


def automaton(pieces: Iterable[bytes], start: bytes = START) -> Automaton:
    """The longest-match automaton of ``pieces`` and all single bytes."""
    children: list[dict[int, int]] = [{}]
    whole = [False]
    for piece in [*(bytes([b]) for b in range(256)), *pieces]:
        node = 0
        for b in piece:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                whole.append(False)
            node = children[node][b]
        whole[node] = node != 0
    fail, pops = np.zeros(len(children), np.int64), np.zeros(len(children), np.int64)
    queue = deque((0, b, c) for b, c in children[0].items())
    while queue:
        parent, byte, node = queue.popleft()
        if whole[node]:
            pops[node], fail[node] = 1, 0
        else:  # pieces of the parent, then of what is left until the byte fits
            n, z = pops[parent], fail[parent]
            while byte not in children[z]:
                n, z = n + pops[z], fail[z]
            pops[node], fail[node] = n, children[z][byte]
        queue.extend((node, b, c) for b, c in children[node].items())
    edges = sorted((s << 8 | b, t) for s, c in enumerate(children) for b, t in c.items())
    keys, targets = np.array(edges, np.int64).T.copy()
    # the state after the mark, and the pieces that reading it has completed (none if the mark is a prefix)
    state = 0
    for b in start:
        if b not in children[state]:
            raise ValueError("the word-start mark must begin a piece")
        state = children[state][b]
    return Automaton(keys, targets, fail, pops, state)


def _counter(a: Automaton):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_tokens = [], []
            for w in W.words(batch.column(0)):
                _, one, which = np.unique(w.hash, return_index=True, return_inverse=True)
                per = a.counts(w.data, w.start[one], w.end[one])[which]
                total = np.concatenate(([0], np.cumsum(per)))
                n_words.append(np.diff(w.bounds))
                n_tokens.append(total[w.bounds[1:]] - total[w.bounds[:-1]])
            join = lambda parts: pa.array(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([join(n_words), join(n_tokens), *batch.columns[1:]],
                                             names=["n_words", "n_tokens", *batch.schema.names[1:]])
    return count


def count_tokens(docs: DataFrame, keep: list[str] | None = None, path: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` (default: all) of ``docs`` with ``n_words`` and ``n_tokens`` of ``text``
    (under other names if the input has these)."""
    keep = docs.columns if keep is None else keep
    n_words, n_tokens = fresh(docs, "n_words", "n_tokens")
    one = docs.select("text", packed_rest(docs, keep).alias("_rest"))
    out = map_arrow(one, _counter(automaton(vocabulary(path))), "n_words bigint, n_tokens bigint", "_rest")
    return out.select(*[F.col("_rest")[c].alias(c) for c in keep],
                      F.col("n_words").alias(n_words), F.col("n_tokens").alias(n_tokens))
