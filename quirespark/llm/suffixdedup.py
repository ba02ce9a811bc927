"""Suffix-array dedup: bytes of 200-byte strings that start anywhere else in the corpus go.

The shards of repeats.py, parts of texts that share most of a window but differ, are concatenated and their suffix
array is built by induced sorting; suffixes that share 200 bytes or more with their neighbour in it, as the
permuted common prefixes tell, start such strings. The stretch that all windows of a part cover, most of it, is
written there as its number in the shard (equal ones, by their bytes, have one).

Matches never cross documents; overlapping strings count; all is judged on the input. Defined
results: null text is empty, nothing of it goes; texts under 200 bytes stay; rows that are equal
in doc_id and text count as so many occurrences and get the same result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import induced, repeats, vec

LENGTH = 200
#: Symbols for the digits of numbers, beside those of the bytes.
BASE = 250
OWN = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _solver(length: int):
    def solve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n = table["n"].to_numpy().astype(np.int64)
        numbers: dict[bytes, int] = {}
        split = []
        for text, core, width in zip(table["symbols"].to_pylist(), table["core"].to_pylist(), table["width"].to_pylist(), strict=True):
            end = core + length - width + 1
            split.append((text[:core], numbers.setdefault(text[core:end], len(numbers)), text[end:], width))
        digits = 1 + (len(numbers) > BASE) + (len(numbers) > BASE**2)
        sizes = np.array([len(a) + digits + len(b) + 1 for a, _, b, _ in split])
        starts = np.cumsum(sizes) - sizes
        filler = bytes(digits)
        data = np.frombuffer(b"".join([x for a, _, b, _ in split for x in (a, filler, b, b"\0")]), np.uint8).astype(np.int64) + 2
        at, core = starts + np.array([len(a) for a, *_ in split]), np.array([c for _, c, *_ in split])
        for k in range(digits):
            data[at + k] = 2 + 256 + core // BASE**k % BASE
        data[starts + sizes - 1] = 1
        text, reach = np.append(data, 0), split[0][3] - 1 + digits
        sa = induced.suffix_array(text)
        common = induced.permuted_common_prefixes(text, sa)
        of = np.concatenate([[0], np.cumsum(n)])
        window = np.full(len(text), -1, np.int64)  # which window starts at a place
        window[np.repeat(starts - of[:-1], n) + np.arange(of[-1])] = np.arange(of[-1])
        again = np.zeros(len(text), bool)
        near = np.flatnonzero(common >= reach)
        before = np.empty(len(text), np.int64)
        before[sa[1:]] = sa[:-1]
        again[near] = True
        again[before[near]] = True
        own = repeats.marks(again[window >= 0], of)
        return pa.table({**{c: table[c] for c in ("fp", "c1", "c2")}, "own": pa.array(own, OWN)})

    return solve


def kind(length: int = LENGTH) -> repeats.Kind:
    return repeats.Kind(False, length, max(1, min(32, length // 2)), False, _solver(length))


def dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = True, **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (bytes) and removed ([start, end) of bytes) of each row of docs(doc_id, text)."""

    def act(batch: pa.RecordBatch, gone: list[np.ndarray]) -> pa.RecordBatch:
        rows: list[list] = [[], [], [], [], []]
        i = 0
        for _, _, data, at in vec.chunks(batch):
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own, raw = data[a:b], gone[i]
                edges = [0, *raw.ravel().tolist(), b - a]
                kept = b"".join(own[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True))
                for column, value in zip(rows, (b - a, b - a - len(kept), len(raw), hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                    column.append(value)
                i += 1
        columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in rows[:3]], pa.array(rows[3], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns += [pa.array(rows[4], pa.binary()), pa.array([g.tolist() for g in gone], pa.list_(pa.list_(pa.int64())))]
            names += ["kept", "removed"]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed array<array<bigint>>" * with_text
    return repeats.applied(docs, kind(length), act, schema, **sizes)
