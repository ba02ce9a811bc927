"""Token counts by greedy word-piece, in linear time and without building a piece.

The vocabulary is a byte trie; a word is matched with the space before it, so tokens that begin with
a space begin words and the others continue them. Where no longer match exists at a node, its
failure link leads to the node of what is left once its popped tokens are split off, and the
number of those is precomputed (after Song et al., "Fast WordPiece Tokenization"). A count is the sum of
popped numbers along one pass over the word; numpy moves all distinct words of a chunk at once.

Defined results: null or empty text has no word and no token; every single byte must be a token
(byte-level vocabularies have them all), so no word is unknown; every row gets its own result, equal
doc_ids too; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .bpe import _send, read_ranks
from .common import map_arrow

#: Longer words are walked one by one.
LONG = 256


class Automaton:
    """Trie with failure links and popped counts; node 0 is the root."""

    def __init__(self, vocabulary: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for token in vocabulary:
            node = 0
            for byte in token:
                to = children[node].get(byte)
                if to is None:
                    to = children[node][byte] = len(children)
                    children.append({})
                    final.append(False)
                node = to
            final[node] = True
        if len(children[0]) < 256 or not all(final[n] for n in children[0].values()):
            raise ValueError("every byte must be a token of the vocabulary")
        n = len(children)
        fail, popped = [0] * n, [0] * n
        level = [0]
        while level:
            below = []
            for u in level:
                for byte, v in children[u].items():
                    below.append(v)
                    if final[v]:
                        fail[v], popped[v] = 0, 1
                        continue
                    z, count = fail[u], popped[u]
                    while byte not in children[z]:
                        count += popped[z]
                        z = fail[z]
                    fail[v], popped[v] = children[z][byte], count
            level = below
        self.children, self.fail, self.popped = children, np.array(fail, np.int32), np.array(popped, np.int32)
        keys = np.array([u << 8 | b for u, c in enumerate(children) for b in c], np.int64)
        to = np.array([v for c in children for v in c.values()], np.int32)
        self.bits = max(10, int(2 * len(keys)).bit_length())
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        rest, at = np.arange(len(keys)), self._slot(keys)
        while len(rest):  # open addressing
            free = self.key[at[rest]] == -1
            _, one = np.unique(at[rest], return_index=True)
            takes = np.zeros(len(rest), bool)
            takes[one] = True
            takes &= free
            self.key[at[rest[takes]]], self.to[at[rest[takes]]] = keys[rest[takes]], to[rest[takes]]
            rest = rest[~takes]
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def go(self, nodes: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The child of each node by each byte, -1 where there is none."""
        keys = nodes.astype(np.int64) << 8 | bytes_
        at = self._slot(keys)
        held = self.key[at]
        out = np.where(held == keys, self.to[at], -1)
        rest = np.flatnonzero((held != keys) & (held != -1))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            held = self.key[at[rest]]
            found = held == keys[rest]
            out[rest[found]] = self.to[at[rest[found]]]
            rest = rest[~found & (held != -1)]
        return out

    def count(self, word: bytes) -> int:
        """Tokens of one word."""
        node, out, children, fail, popped = 0, 0, self.children, self.fail, self.popped
        for byte in b" " + word:
            while byte not in children[node]:
                out += int(popped[node])
                node = int(fail[node])
            node = children[node][byte]
        while node:
            out += int(popped[node])
            node = int(fail[node])
        return out

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each word data[start:end]."""
        out = np.zeros(len(start), np.int64)
        long = np.flatnonzero(end - start > LONG)
        for i in long.tolist():
            out[i] = self.count(data[start[i] : end[i]].tobytes())
        lane = np.flatnonzero(end - start <= LONG)
        at, stop = start[lane].astype(np.int64), end[lane]
        node = np.full(len(lane), self.children[0][0x20], np.int32)
        while len(lane):
            inside = at < stop
            to = np.full(len(lane), -1, np.int32)
            to[inside] = self.go(node[inside], data[at[inside]].astype(np.int64))
            moved = to >= 0
            out[lane[~moved]] += self.popped[node[~moved]]
            node = np.where(moved, to, self.fail[node])
            at += moved
            on = (node != 0) | (at < stop)
            lane, at, stop, node = lane[on], at[on], stop[on], node[on]
        return out


_automata: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _automata:
        with open(path, "rb") as f:
            _automata[path] = Automaton(list(read_ranks(f)))
    return _automata[path]


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, most_in_word of each row of docs(doc_id, text); words are `[^\\x20\\x09-\\x0D]+`."""
    name = _send(docs, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(SparkFiles.get(name))
        for batch in batches:
            n_words, n_tokens, most = [], [], []
            for _, _, data, at in vec.chunks(batch):
                start, end, of = vec.words(data, at, vec.NONSPACE)
                one, which = vec.first_of_equal(data, start, end)
                each = own.counts(data, start[one], end[one])[which]
                sums = np.concatenate([[0], np.cumsum(each)])
                n_words.append(np.diff(of))
                n_tokens.append(sums[of[1:]] - sums[of[:-1]])
                full = np.flatnonzero(np.diff(of))
                top = np.zeros(len(of) - 1, np.int64)
                if len(full):
                    top[full] = np.maximum.reduceat(each, of[:-1][full])
                most.append(top)
            join = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), join(n_words), join(n_tokens), join(most)], ["doc_id", "n_words", "n_tokens", "most_in_word"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(texts, run, "doc_id long, n_words long, n_tokens long, most_in_word long")
