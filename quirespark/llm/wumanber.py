"""Benchmark decontamination by Wu-Manber search over words.

Symbols are word hashes, patterns the windows of 13 consecutive words of each benchmark item (an
item of fewer words is one window). Patterns of one length L form a table: the shift of a block of
two words is the least distance from its occurrences in the patterns to their ends, L - 1 for
a block that occurs in none. Every lane, a stretch of a text, jumps by these shifts; where the shift
is 0 the hash of the pattern's last words selects a bucket, and the words are compared
one by one, first as hashes, then as bytes. numpy moves all lanes of a chunk at once.

Defined results: null or empty text has no words and isn't contaminated; null or empty items have
no window; equal windows of several items count for each of them; rows with equal doc_id each
get their own result; extra columns are ignored; an empty benchmark hits nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vec
from .common import cut, map_arrow

WINDOW = 13
#: Text of a benchmark shard that is sent to every executor; a larger benchmark is searched for shard by shard.
SHARD_BYTES = 8 << 20
#: Words of a lane.
LANE = 512


class Patterns:
    """The windows of one length and their block shift and suffix tables."""

    def __init__(self, words: np.ndarray, items: list[list[int]], texts: list[list[bytes]]):
        self.words, self.items, self.texts = words, items, texts
        n, length = words.shape
        self.length, self.block = length, min(2, length)
        blocks = length - self.block + 1
        keys = self.block_keys(words)
        shift = np.broadcast_to(np.arange(blocks - 1, -1, -1), keys.shape)
        order = np.lexsort((shift.ravel(), keys.ravel()))
        flat = keys.ravel()[order]
        first = np.concatenate([[True], flat[1:] != flat[:-1]])
        self.keys, self.shifts = flat[first], shift.ravel()[order][first]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        suffix = keys[:, -1]
        by = np.argsort(suffix, kind="stable")
        self.by, self.suffix = by, suffix[by]

    def block_keys(self, words: np.ndarray) -> np.ndarray:
        if self.block == 1:
            return words
        return words[..., :-1] * np.uint64(0x9FB21C651E98DF25) + words[..., 1:]

    def find(self, hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of the occurrences in texts whose words are hashes[of[i]:of[i+1]], as hashes tell."""
        m, reach = self.length, self.length - self.block + 1
        first, last = of[:-1], of[1:] - m  # the first and last places of a window
        long = last >= first
        first, last = first[long], last[long]
        lanes = (last - first) // LANE + 1
        start = np.repeat(first, lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(start + LANE - 1, np.repeat(last, lanes))
        places, patterns = [], []
        while len(start):
            tail = start + (m - self.block)
            key = hashes[tail] if self.block == 1 else hashes[tail] * np.uint64(0x9FB21C651E98DF25) + hashes[tail + 1]
            step = np.full(len(start), reach)
            maybe = np.flatnonzero(self.filter[(key & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if len(maybe):
                k = key[maybe]
                i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
                known = self.keys[i] == k
                step[maybe[known]] = self.shifts[i[known]]
            hit = np.flatnonzero(step == 0)
            if len(hit):
                step[hit] = 1
                lo, hi = np.searchsorted(self.suffix, key[hit], "left"), np.searchsorted(self.suffix, key[hit], "right")
                width = hi - lo
                place = np.repeat(start[hit], width)
                pattern = self.by[np.repeat(lo, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)]
                for j in range(m):
                    same = hashes[place + j] == self.words[pattern, j]
                    place, pattern = place[same], pattern[same]
                places.append(place)
                patterns.append(pattern)
            start = start + step
            on = start <= stop
            start, stop = start[on], stop[on]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(patterns)


def tables(items: list[tuple[int, str | None]], window: int = WINDOW) -> list[Patterns]:
    """A Patterns for each length of window that the items have."""
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for item, text in items:
        data = vec.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        if not len(data):
            continue
        start, end, _ = vec.words(data, np.array([0, len(data)]), vec.ALNUM)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        length = min(window, len(words))
        for i in range(len(words) - length + 1 if length else 0):
            held = by_length.setdefault(length, {}).setdefault(tuple(words[i : i + length]), [])
            if item not in held:
                held.append(item)
    out = []
    for windows in by_length.values():
        texts = [list(w) for w in windows]
        raw = b" ".join(w for t in texts for w in t)
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum([len(w) + 1 for t in texts for w in t]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        out.append(Patterns(vec.word_hashes(data, starts, ends).reshape(len(texts), -1), list(windows.values()), texts))
    return out


_held: dict[tuple[str, int], list[Patterns]] = {}


def _searched(shard: tuple[str, list[tuple[int, str]]], window: int) -> list[Patterns]:
    """The tables of a shard, built once in a worker, which holds those of one shard at a time."""
    key = (shard[0], window)
    if key not in _held:
        _held.clear()
        _held[key] = tables(shard[1], window)
    return _held[key]


def _search(shard: Broadcast, window: int, keep_text: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = _searched(shard.value, window)
        for batch in batches:
            n_words: list[int] = []
            held = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            spans: list[list[list[int]]] = held["spans"].to_pylist() if "spans" in held else [[] for _ in range(batch.num_rows)]
            found: list[set[int]] = [set(x) for x in held["items"].to_pylist()] if "items" in held else [set() for _ in range(batch.num_rows)]
            for lo, hi, data, at in vec.chunks(batch):
                lower = vec.LOWER[data]
                start, end, of = vec.words(lower, at, vec.ALNUM)
                hashes = vec.word_hashes(lower, start, end)
                raw = lower.tobytes()
                runs: list[list[list[int]]] = [[] for _ in range(hi - lo)]
                for p in searched:
                    places, patterns = p.find(hashes, of)
                    order = np.argsort(places, kind="stable")
                    rows = np.searchsorted(of, places, "right") - 1
                    for i in order.tolist():
                        place, pattern, row = int(places[i]), int(patterns[i]), int(rows[i])
                        if all(raw[start[place + j] : end[place + j]] == w for j, w in enumerate(p.texts[pattern])):
                            found[lo + row].update(p.items[pattern])
                            a = place - int(of[row])
                            if runs[row] and runs[row][-1][0] <= a <= runs[row][-1][1]:
                                runs[row][-1][1] = max(runs[row][-1][1], a + p.length)
                            else:
                                runs[row].append([a, a + p.length])
                n_words += np.diff(of).tolist()
                for row, own in enumerate(runs):
                    spans[lo + row] += own
            longs = pa.list_(pa.int64())
            out = {"doc_id": held["doc_id"], "kept": held["kept"], **({"text": held["text"]} if keep_text else {}), "n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, pa.list_(longs)), "items": pa.array([sorted(x) for x in found], longs)}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return search


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()


def _shard_count(benchmark: DataFrame) -> int:
    return 1 + _items(benchmark).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // SHARD_BYTES


def _shard(benchmark: DataFrame, k: int, n: int) -> tuple[str, list[tuple[int, str]]]:
    """A name and part k of the benchmark's n, about SHARD_BYTES of text; the sum over all was taken before."""
    return uuid.uuid4().hex, [(r.item_id, r.text) for r in _items(benchmark).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, spans (runs of hit words, [start, end) from 0), items (ids, sorted), n_hit, contaminated and kept, a struct of the columns
    named in keep, of each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), kept.alias("kept"))
    of = {f.name: f for f in out.schema.fields} | {f.name: f for f in T._parse_datatype_string("n_words long, spans array<array<bigint>>, items array<bigint>").fields}
    n = _shard_count(benchmark)
    for k in range(n):  # each row's findings grow from shard to shard
        last = k == n - 1
        search = _search(spark.sparkContext.broadcast(_shard(benchmark, k, n)), window, not last)
        out = map_arrow(out, search, T.StructType([of[c] for c in ("doc_id", "kept", *(() if last else ("text",)), "n_words", "spans", "items")]))
        if not last:
            out = cut(out, "shard").drop("n_words")
    joined = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x[1] - F.greatest(x[0], s["end"]))).alias("n"), F.greatest(s["end"], x[1]).alias("end")),
    )
    return out.withColumn("n_hit", joined["n"]).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
