"""What the two substring operators share: finding, over the whole corpus, the windows that occur again.

1. Every text is cut into runs of windows with one anchor (anchors.py): equal windows lie in runs of
   equal anchor hashes, at one place in them. Runs whose anchor occurs once are done with.
2. Runs of one anchor and one context (by 96 bits of BLAKE2b) are copies of each other: a verdict for all their
   windows follows from their number or order. One of them, the first of the corpus, stands for the class.
3. Where an anchor has several contexts, the classes' contexts are fetched and refined: each is split by the place of the
   anchor in its windows, and the stretch that all windows of a part cover is the new, longer anchor, its core. Windows of
   different parts or anchors differ; parts whose new anchor occurs once are done with, equal parts are one class.
4. Parts that share an anchor but differ go to the solver of the operator, whole groups in shards of
   at most SHARD symbols. A group that is larger is refined again, by finer parts, down to single windows, of which all
   in a group are equal. So no task gets more than a shard, whatever number of texts shares a passage.
5. The verdicts are joined back to classes, runs and texts.

Hashes of anchors only keep apart what can't be equal. Rows are told apart by (doc_id, hash of text), so rows that are
equal in both get one result.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import anchors, vec
from .common import cut, map_arrow

#: Bytes of the contexts that a solver gets at once, and most tasks that shards are dealt to.
SHARD, TASKS = 200_000, 20_000
#: A part has this share of the places that the anchor can have.
FINER = 4
NO_ID = -(2**63)
_RUN = "fp long, c1 long, c2 int, id long, lo int, n int, place int"
OWN = "array<struct<a:int,b:int>>"


class Kind(NamedTuple):
    """What a text's symbols are, and what counts as removed."""

    words: bool
    window: int
    k: int
    #: True: the first occurrence stays; False: all go that occur again.
    first_stays: bool
    solve: Callable[[pa.Table], pa.Table]


def keyed(docs: DataFrame) -> DataFrame:
    """(id, h, doc_id, text): id and h tell rows apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"), doc_id.alias("doc_id"), text.alias("text"))


class Chunk:
    """The symbols of some texts: as numbers that choose anchors, and as bytes that decide what is equal."""

    def __init__(self, kind: Kind, data: np.ndarray, at: np.ndarray):
        if kind.words:
            start, end, self.of = vec.words(data, at, vec.NONSPACE)
            self.raw, self.begin = vec.joined_words(data, start, end)
            self.values, self.gap = vec.word_hashes(data, start, end), 1
        else:
            self.raw, self.of, self.values, self.gap = data.tobytes(), at, vec.byte_values(data), 0
            self.begin = None

    def edges(self, first: np.ndarray, last: np.ndarray) -> zip:
        """Where the bytes of symbols first..last - 1 begin and end."""
        if self.begin is None:
            return zip(first.tolist(), last.tolist(), strict=True)
        return zip(self.begin[first].tolist(), (self.begin[last] - 1).tolist(), strict=True)


def _digests(texts: Iterator[bytes], place: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """96 bits for each context and the place of the anchor in it."""
    both = np.frombuffer(b"".join([blake2b(t, digest_size=12).digest() for t in texts]), np.dtype([("c1", "<i8"), ("c2", "<i4")]))
    return pa.array(both["c1"] + place), pa.array(both["c2"].copy())


def _anchors(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in vec.chunks(batch):
                chunk = Chunk(kind, data, at)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.runs(chunk.values, chunk.of, kind.window, kind.k)[2].view(np.int64))], ["fp"])

    return run


def _runs(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, _, data, at in vec.chunks(batch):
                chunk = Chunk(kind, data, at)
                lo, hi, anchor, place = anchors.runs(chunk.values, chunk.of, kind.window, kind.k)
                text = np.searchsorted(chunk.of, lo, "right") - 1
                raw = chunk.raw
                c1, c2 = _digests((raw[a:b] for a, b in chunk.edges(lo, hi - 1 + kind.window)), place)
                ints = [pa.array(x.astype(np.int32)) for x in (lo - chunk.of[text], hi - lo, place)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), c1, c2, pa.array(ids[row + text]), *ints, pa.array(hashes[row + text])], ["fp", "c1", "c2", "id", "lo", "n", "place", "h"])

    return run


def _fetch(kind: Kind):
    """From (id, text, wanted: [(fp, c1, c2, lo, n, place)]) the contexts of the wanted runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, ids = batch.column(batch.schema.get_field_index("wanted")), batch.column(batch.schema.get_field_index("id")).to_numpy()
            for row, last, data, at in vec.chunks(batch):
                chunk = Chunk(kind, data, at)
                own = wanted.slice(row, last - row)
                count = pc.list_value_length(own).to_numpy().astype(np.int64)
                fields = dict(zip(("fp", "c1", "c2", "lo", "n", "place"), own.flatten().flatten(), strict=True))
                first = fields["lo"].to_numpy() + np.repeat(chunk.of[:-1], count)
                raw = chunk.raw
                texts = [raw[a:b] for a, b in chunk.edges(first, first + fields["n"].to_numpy() + kind.window - 1)]
                columns = [*(fields[c] for c in ("fp", "c1", "c2")), pa.array(np.repeat(ids[row:last], count)), *(fields[c] for c in ("lo", "n", "place")), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["fp", "c1", "c2", "id", "lo", "n", "place", "symbols"])

    return run


def _refine(kind: Kind, width: int):
    """The parts of each context: those of its windows that have the anchor at one of `width` places."""

    def parts(batch: pa.RecordBatch) -> Iterator[tuple]:
        window = kind.window
        rows = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        for i, (n, place, text) in enumerate(zip(rows["n"], rows["place"], rows["symbols"], strict=True)):
            symbols = text.split(b" ") if kind.words else text
            cut_out = (lambda a, b, s=symbols: b" ".join(s[a:b])) if kind.words else (lambda a, b, s=symbols: s[a:b])
            for part in range((place - n + 1) // width, place // width + 1):
                a, b = part * width, (part + 1) * width
                first, stop = max(0, place - b + 1), min(n, place - a + 1)
                common = cut_out(place - a, place - b + 1 + window)
                yield i, first, stop - first, place - first, place - a - first, blake2b(common, digest_size=8, salt=part.to_bytes(4, "little")).digest(), cut_out(first, stop - 1 + window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                held = batch.slice(lo, 200)
                of, first, n, place, core, keys, texts = zip(*parts(held), strict=True)
                place = np.array(place)
                c1, c2 = _digests(iter(texts), place)
                parent = held.take(pa.array(of))
                lo_ = parent.column("lo").to_numpy() + np.array(first)
                columns = [pa.array(np.frombuffer(b"".join(keys), np.int64)), c1, c2, parent.column("id"), *(pa.array(np.array(x, np.int32)) for x in (lo_, n, place)), pa.array(texts, pa.binary()), pa.array(core, pa.int32()), *(parent.column(c) for c in ("fp", "c1", "c2")), pa.array(first, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["fp", "c1", "c2", "id", "lo", "n", "place", "symbols", "core", "pf", "p1", "p2", "off"])

    return run


def _free() -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that are done with: the next steps need their disk."""
    from pyspark import SparkContext

    gc.collect()
    if SparkContext._jvm is not None:
        SparkContext._jvm.System.gc()


def _whole(kind: Kind, own: Column, first: Column) -> Column:
    """The ranges of a run: all windows of a copy, the class's own ranges otherwise."""
    again = (first["id"] != F.col("id")) | (first["lo"] != F.col("lo")) if kind.first_stays else F.col("c") > 1
    return F.when(again, F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))).otherwise(F.coalesce(own, F.array().cast(OWN)))


def _moved(ranges: Column, by: Column) -> Column:
    return F.transform(ranges, lambda x: F.struct((by + x["a"]).alias("a"), (by + x["b"]).alias("b")))


def _several(classes: DataFrame) -> DataFrame:
    """fp of the groups of several classes, with their number and bytes."""
    size = F.sum(F.octet_length("symbols")) if "symbols" in classes.columns else F.count("*")
    return classes.groupBy("fp").agg(F.count("*").alias("m"), size.alias("size")).where("m > 1")


def _decided(contexts: DataFrame, kind: Kind, width: int, shard: int) -> DataFrame:
    """(fp, c1, c2, own): the windows that go of each of contexts(fp, c1, c2, id, lo, n, place, symbols), as far as other contexts tell."""
    parts = cut(map_arrow(contexts, _refine(kind, width), f"{_RUN}, symbols binary, core int, pf long, p1 long, p2 int, off int"), "parts")
    met = cut(parts.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp"), "part-anchors", True)
    parts = cut(parts.join(met, "fp"), "met")
    first = F.min(F.struct("id", "lo", "n", "place", "core", "symbols")).alias("first")
    classes = cut(parts.groupBy("fp", "c1", "c2").agg(F.count("*").alias("c"), first).select("fp", "c1", "c2", "c", "first.*"), "part-classes")
    _free()
    groups = cut(_several(classes), "groups", True)
    is_small = F.lit(True) if width == 1 else F.col("size") <= shard
    total, large = groups.agg(F.coalesce(F.sum(F.when(is_small, F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(~is_small, 1)), F.lit(0))).first()
    runs = ("fp", "c1", "c2", "id", "lo", "n", "place", "symbols")
    dealt = classes.join(groups.where(is_small).select("fp"), "fp").select(*runs, "core", F.lit(width).alias("width"), F.pmod(F.xxhash64("fp"), F.lit(1 + total // shard)).alias("shard"))
    solved = dealt.repartition(min(TASKS, 1 + total // shard), "shard").groupBy("shard").applyInArrow(kind.solve, f"fp long, c1 long, c2 int, own {OWN}")
    if large:
        solved = solved.unionByName(_decided(classes.join(groups.where(~is_small).select("fp"), "fp").select(*runs), kind, -(-width // FINER), shard))
    verdicts = classes.select("fp", "c1", "c2", "c", F.struct("id", "lo").alias("first")).join(solved.where(F.size("own") > 0), ["fp", "c1", "c2"], "left").where("c > 1 or own is not null")
    verdicts = cut(verdicts, "part-verdicts", True)
    own = parts.drop("symbols").join(verdicts, ["fp", "c1", "c2"]).select("pf", "p1", "p2", _moved(_whole(kind, F.col("own"), F.col("first")), F.col("off")).alias("own")).where(F.size("own") > 0)
    own = own.groupBy("pf", "p1", "p2").agg(F.flatten(F.collect_set("own")).alias("own"))  # parts of one context
    return cut(own.select(F.col("pf").alias("fp"), F.col("p1").alias("c1"), F.col("p2").alias("c2"), "own"), "decided", True)


def spans(docs: DataFrame, kind: Kind, shard: int = SHARD) -> DataFrame:
    """(id, h, spans): for each row of keyed(docs) with any, the ranges [start, end) of windows (by their first symbol) that go."""
    texts = keyed(docs)
    again = map_arrow(texts.select("text"), _anchors(kind), "fp long").groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp")
    again = cut(again, "again", True)  # so that the join has two plain exchanges, whose hot partitions AQE splits
    _free()
    runs = cut(map_arrow(texts.select("id", "h", "text"), _runs(kind), f"{_RUN}, h long").join(again, "fp"), "repeated")
    _free()
    classes = cut(runs.groupBy("fp", "c1", "c2").agg(F.count("*").alias("c"), F.min(F.struct("id", "lo", "h", "n", "place")).alias("first")), "classes")
    open_ = classes.join(cut(_several(classes).select("fp"), "groups", True), "fp")
    wanted = open_.select("first.id", "first.h", F.struct("fp", "c1", "c2", "first.lo", "first.n", "first.place").alias("w")).groupBy("id", "h").agg(F.collect_list("w").alias("wanted"))  # runs of one text
    fetched = texts.select("id", "h", "text").join(wanted, ["id", "h"]).select("id", "text", "wanted")  # of equal rows each; their copies are one class
    contexts = map_arrow(fetched, _fetch(kind), f"{_RUN}, symbols binary")
    own = _decided(contexts, kind, -(-(kind.window - kind.k + 1) // FINER), shard)
    verdicts = classes.select("fp", "c1", "c2", "c", "first").join(own, ["fp", "c1", "c2"], "left").where("c > 1 or own is not null")
    verdicts = cut(verdicts.select("fp", "c1", "c2", "c", F.struct("first.id", "first.lo").alias("first"), "own"), "verdicts", True)
    _free()
    hit = runs.join(verdicts, ["fp", "c1", "c2"]).select("id", "h", _moved(_whole(kind, F.col("own"), F.col("first")), F.col("lo")).alias("own")).where(F.size("own") > 0)
    return hit.groupBy("id", "h").agg(F.flatten(F.collect_set("own")).alias("spans"))  # those of one text


def removed(ranges: np.ndarray, window: int) -> np.ndarray:
    """Maximal runs [start, end) of the symbols that windows starting in ranges cover."""
    if not len(ranges):
        return np.zeros((0, 2), np.int64)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    start, end = ranges[:, 0], np.maximum.accumulate(ranges[:, 1] + window - 1)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)
    return np.stack([start[new], end[last]], 1)


def applied(docs: DataFrame, kind: Kind, act: Callable, schema: str, **sizes: int) -> DataFrame:
    """act's columns for each row: act(batch, the rows' removed runs) -> batch."""
    found = spans(docs, kind, **sizes)
    joined = keyed(docs).join(found, ["id", "h"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(2)
            gone = []
            for i in range(batch.num_rows):
                s = held[i]
                ranges = np.stack([s.values.field(0).to_numpy(), s.values.field(1).to_numpy()], 1).astype(np.int64) if s.is_valid else np.zeros((0, 2), np.int64)
                gone.append(removed(ranges, kind.window))
            yield act(batch, gone)

    return map_arrow(joined, run, schema)


def marks(starts: np.ndarray, of: np.ndarray) -> list[list[dict[str, int]]]:
    """Ranges [a, b) of the true windows of each context; starts: a flag for each window, of: the contexts' offsets among them."""
    n = len(starts)
    edge = np.zeros(n + 1, bool)
    edge[of] = True
    before = np.concatenate([[False], starts[:-1]]) & ~edge[:n]
    after = np.concatenate([starts[1:], [False]]) & ~edge[1:]
    a, b = np.flatnonzero(starts & ~before), np.flatnonzero(starts & ~after) + 1
    context = np.searchsorted(of, a, "right") - 1
    out: list[list[dict[str, int]]] = [[] for _ in range(len(of) - 1)]
    for c, x, y in zip(context.tolist(), (a - of[context]).tolist(), (b - of[context]).tolist(), strict=True):
        out[c].append({"a": x, "b": y})
    return out
