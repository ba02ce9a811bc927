"""Substring dedup: words of 20-word windows that start earlier in the corpus go.

Each shard of repeats.py, parts of texts that share most of a window but differ, is a reference shard: a suffix
automaton over its word sequences, whose size is bounded by the shard's. The same stretches of the documents
then stream through it, and their matching statistics, held at the length of a window, lead to the state of each
window: equal windows have one state. Of a state's windows all but the earliest go. The words that all windows of a
part cover, most of them, are one symbol there. What is earlier is smaller in
doc_id, or in the same document further ahead.

A shard goes to the one task that has its documents instead of to all: all shards together grow with the corpus.

Windows never cross documents; all is judged on the input. Defined results: null or empty text has no word;
rows of one doc_id are versions of one document: of two equal windows at one place in both neither is
earlier; a null doc_id is smaller than all others; bytes that aren't UTF-8 become U+FFFD in kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats, vec
from .suffixdedup import OWN

LENGTH = 20


class Automaton:
    """A suffix automaton of several sequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def states(self, values: list[int], window: int) -> list[int]:
        """The state of each window of one of the sequences."""
        out, state = [], 0
        next_, link, lengths = self.next, self.link, self.length
        for v in values:
            state = next_[state][v]
            while lengths[link[state]] >= window:  # what is longer than a window is let go
                state = link[state]
            out.append(state)
        return out[window - 1 :]

    def add(self, values: list[int]) -> None:
        last = 0
        for v in values:
            last = self._extend(last, v)

    def _split(self, p: int, v: int, q: int) -> int:
        """A copy of q for the shorter stretches that reach it from p."""
        next_, link, length = self.next, self.link, self.length
        copy = len(next_)
        next_.append(next_[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and next_[p].get(v) == q:
            next_[p][v] = copy
            p = link[p]
        return copy

    def _extend(self, last: int, v: int) -> int:
        next_, link, length = self.next, self.link, self.length
        q = next_[last].get(v)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._split(last, v, q)
        new, p = len(next_), last
        next_.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and v not in next_[p]:
            next_[p][v] = new
            p = link[p]
        if p >= 0:
            q = next_[p][v]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, v, q)
        return new


def _solver(length: int):
    def solve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        numbers: dict[bytes, int] = {}
        texts = []
        for text, core, width in zip(table["symbols"].to_pylist(), table["core"].to_pylist(), table["width"].to_pylist(), strict=True):
            words, end = text.split(b" "), core + length - width + 1
            shared = b" ".join(words[core:end])  # words have no space: no word of its own unless it is one
            texts.append([numbers.setdefault(w, len(numbers)) for w in (*words[:core], shared, *words[end:])])
        reference = Automaton()
        for values in texts:
            reference.add(values)
        n = table["n"].to_numpy().astype(np.int64)
        of = np.concatenate([[0], np.cumsum(n)])
        state = np.array([s for values in texts for s in reference.states(values, width)], np.int64)
        ids = np.repeat(table["id"].to_numpy(), n)
        start = np.repeat(table["lo"].to_numpy() - of[:-1], n) + np.arange(of[-1])
        order = np.lexsort((start, ids, state))
        lead = np.concatenate([[True], np.diff(state[order]) > 0])
        first = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
        gone = np.zeros(len(state), bool)
        gone[order] = (ids[order] != ids[first]) | (start[order] != start[first])
        return pa.table({**{c: table[c] for c in ("fp", "c1", "c2")}, "own": pa.array(repeats.marks(gone, of), OWN)})

    return solve


def kind(length: int = LENGTH) -> repeats.Kind:
    return repeats.Kind(True, length, max(1, min(6, length // 2)), True, _solver(length))


def dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = True, **sizes: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (text) and removed ([start, end) of words) of each row of docs(doc_id, text)."""

    def act(batch: pa.RecordBatch, gone: list[np.ndarray]) -> pa.RecordBatch:
        n_words, n_removed, hashes, kept_texts = [], [], [], []
        i = 0
        for _, _, data, at in vec.chunks(batch):
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                words = bytes(data[a:b]).split()
                edges = [0, *gone[i].ravel().tolist(), len(words)]
                kept = b" ".join([w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y]])
                n_words.append(len(words))
                n_removed.append(int((gone[i][:, 1] - gone[i][:, 0]).sum()))
                hashes.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode("utf-8", "replace"))
                i += 1
        columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(hashes, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns += [pa.array(kept_texts, pa.string()), pa.array([g.tolist() for g in gone], pa.list_(pa.list_(pa.int64())))]
            names += ["kept", "removed"]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, removed array<array<bigint>>" * with_text
    return repeats.applied(docs, kind(length), act, schema, **sizes)
