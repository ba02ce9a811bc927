"""MinHash near-duplicates with min-max hashing.

Every document is the set of its distinct five-word shingles. Under each of 64 permutations both
the minimum and the maximum are kept: 128 signature values for 64 evaluations, each agreeing with
probability equal to the Jaccard similarity. 32 bands of four values, all of different permutations, give candidates
(at similarity 0.75 all bands miss a pair with a probability of 5e-6), which are confirmed on the full sets.

Equal sets are one class, stood for by its smallest doc_id, so copies never meet pairwise. In each
bucket two members, drawn by a hash of the document, so that buckets of the same members have the same ones, are the hubs and are compared with every
other. Where a bucket still holds several components after that, its members outside the largest are
compared with all of other components, so no link between different texts is lost to the hubs. Where that were more comparisons than the bucket's members
have shingles, or more than CROWD are outside, the members of all such buckets go through one exact prefix join instead, over full sets and with the rarest
shingles first: it gives the same links, so a result never depends on how full a bucket is. Those pairs are left out whose
sizes, or whose parities of shingles in 1024 classes, prove them too far apart (each parity
that differs is a shingle, at least, which only one of them has).

Defined results: null or empty text has no shingle and is linked with nothing; rows with equal
doc_id are one document; a row without doc_id is kept and linked with nothing; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .common import components, cut, map_arrow

SHINGLE, SIMILAR = 5, 75
PERMUTATIONS, BAND = 64, 4
PARITIES = 1024
#: Most members outside a bucket's largest component that are compared with all others there; more are met by rare shingles. Both find all that is similar.
CROWD = 2048
#: Size bands of the prefix join in a factor of e.
BANDS = 8
#: Bits of the bitmap that sieves rows before they are dealt out: 1 MB.
SIEVE = 1 << 23
_MULTIPLIERS = np.random.default_rng(31).integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALT = np.random.default_rng(32).integers(1, 2**63, 2 * PERMUTATIONS // BAND, dtype=np.uint64)


def shingle_sets(batch: pa.RecordBatch, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row's text."""
    for lo, hi, data, at in vec.chunks(batch):
        lower = vec.LOWER[data]
        start, end, of = vec.words(lower, at, vec.NONSPACE)
        hashes = vec.exact_span(vec.exact_prefix(lower), start, end)
        grams = vec.grams(hashes, k)
        for row in range(hi - lo):
            a, b = of[row], of[row + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield vec.grams(hashes[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def signature(items: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a set under each permutation, side by side."""
    out = np.empty((PERMUTATIONS, 2), np.uint64)
    for i in range(0, len(items), 4096):
        seen = _MULTIPLIERS[:, None] * items[None, i : i + 4096]
        low, high = seen.min(1), seen.max(1)
        out[:, 0] = low if not i else np.minimum(out[:, 0], low)
        out[:, 1] = high if not i else np.maximum(out[:, 1], high)
    return out


def band_keys(items: np.ndarray) -> np.ndarray:
    values = signature(items).T.reshape(-1, BAND)
    h = _BAND_SALT.copy()
    for i in range(BAND):
        h = vec.mix(h * np.uint64(0x9FB21C651E98DF25) + values[:, i])
    return h.view(np.int64)


def parities(items: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((items >> np.uint64(20) & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, keys, bits = [], [], [], []
        for items in shingle_sets(batch):
            some = len(items) > 0
            sizes.append(len(items))
            digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if some else None)
            keys.append(band_keys(items) if some else None)
            bits.append(parities(items) if some else None)
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, longs), pa.array(bits, longs)], ["doc_id", "n_shingles", "digest", "keys", "bits"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, held = 0, []
        for items in shingle_sets(batch):
            held.append(items.view(np.int64))
            if len(held) == 512 or at + len(held) == batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), pa.array(held, pa.list_(pa.int64()))], ["doc_id", "items"])
                at, held = at + len(held), []


def _near_enough(pairs: DataFrame) -> DataFrame:
    """Those of pairs(n1, n2, bits1, bits2, ...) that sizes and parities don't prove too far apart."""
    apart = reduce(lambda p, q: p + q, [F.bit_count(F.get("bits1", F.lit(i)).bitwiseXOR(F.get("bits2", F.lit(i)))) for i in range(PARITIES // 64)])
    fits = 100 * F.least("n1", "n2") >= SIMILAR * F.greatest("n1", "n2")
    return pairs.where(fits).where((100 + SIMILAR) * apart <= (100 - SIMILAR) * (F.col("n1") + F.col("n2")))


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of rows(doc_id, ...) whose doc_id is in ids(doc_id), distinct ones.

    Before the exact join, which deals both sides out, rows are sieved by a bitmap of the ids' hashes; its size is fixed, whatever the input's.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE)) + 1
    at = [F.bitmap_bucket_number(bit).alias("_part"), F.bitmap_bit_position(bit).cast("int").alias("_bit")]
    sieve = ids.select(*at).groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    octet = F.conv(F.hex(F.substr("_map", F.shiftright("_bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.select("*", *at).join(F.broadcast(sieve), "_part").where(F.getbit(octet, F.col("_bit").bitwiseAND(F.lit(7))) == 1)
    return held.drop("_part", "_bit", "_map").join(ids, "doc_id")


def _ends(pairs: DataFrame) -> DataFrame:
    """doc_id: the distinct members of pairs(a, b), written, as they are read for the sieve and for the join."""
    return cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends", True)


def _sets_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, items: the full sets of those texts whose doc_id is in ids, distinct ones."""
    return map_arrow(_among(texts, ids).select("doc_id", "text"), _sets, "doc_id long, items array<bigint>")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs(a, b) whose full sets are similar enough."""
    sets = _sets_of(texts, _ends(pairs))
    met = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")
    both = F.size(F.array_intersect("x", "y"))
    return met.where(100 * both >= SIMILAR * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """members(key, doc_id) of those buckets that hold several components, with c, their component, main, the bucket's largest, and outside, how many aren't in it."""
    at = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")
    at = cut(at, "placed")
    own = at.groupBy("key", "c").agg(F.count("*").alias("n_c")).groupBy("key").agg((F.sum("n_c") - F.max("n_c")).alias("outside"), F.max(F.struct("n_c", "c"))["c"].alias("main")).where("outside > 0")
    return cut(at.join(cut(own, "mixed", True), "key"), "rest", True)


def _across(rows: DataFrame) -> DataFrame:
    """Pairs of rows(key, doc_id, c, main, n, ...) of equal keys and different components, each column with 1 or 2 at its end.

    Those in the bucket's largest component are only met with those outside it, never with each other.
    """
    side = lambda i: rows.select("key", *[F.col(c).alias(f"{c}{i}") for c in rows.columns if c != "key"])
    return side(1).where("c1 <> main1").join(side(2), "key").where("c1 <> c2 and (c2 = main2 or doc_id1 < doc_id2)")


def _by_prefix(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows(doc_id, c), distinct ones, of different components: all that are similar, and some others.

    Of a set of n shingles, in any order that all sets share, similar sets have one of their first n - ceil(0.75 n) + 1 in common. So members
    are met by shingles instead of each with each, those of the fewest comparisons first; shingles that one component holds meet nothing.
    Of two similar sets the first common shingle has enough others after it in both.
    """
    sets = cut(_sets_of(texts, rows.select("doc_id")).dropDuplicates(["doc_id", "items"]), "crowd-sets", True)
    items = rows.join(sets, "doc_id").select("doc_id", "c", F.size("items").alias("n"), F.xxhash64("items").alias("which"), F.explode("items").alias("item"))
    holders, own = Window.partitionBy("item"), Window.partitionBy("doc_id", "which")
    items = items.repartition("item").withColumn("n_c", F.count("*").over(Window.partitionBy("item", "c"))).withColumn("f", F.count("*").over(holders)).withColumn("most", F.max(F.struct("n_c", "c")).over(holders))
    shared = items.where("f > most.n_c").withColumn("cost", F.col("f") * (F.col("f") - F.col("most.n_c"))).withColumn("main", F.col("most.c"))
    met = shared.withColumn("alone", F.col("n") - F.count("*").over(own)).withColumn("place", F.col("alone") + F.row_number().over(own.orderBy("cost", "item")))
    # The smaller of two sets looks, in its own size band, among larger ones; these are in the bands of all sizes that they may be similar to from this place on.
    lowest = F.ceil(SIMILAR * F.col("n") / 100)
    met = met.withColumn("after", F.col("n") - F.col("place") + 1).withColumn("reach", F.least("n", F.floor((100 + SIMILAR) * F.col("after") / SIMILAR) - F.col("n"))).where(F.col("reach") >= lowest)
    met = cut(met.select("item", "doc_id", "c", "n", "after", "reach", (F.col("c") == F.col("main")).alias("within")), "prefixes", True)
    band = lambda n: F.floor(F.log(n) * BANDS)
    side = lambda rows, i, at: rows.select("item", *[F.col(k).alias(f"{k}{i}") for k in ("doc_id", "c", "n", "after")], at.alias("band"))
    small = lambda rows: side(rows.where("reach = n"), 1, band(F.col("n")))
    large = lambda rows: side(rows, 2, F.explode(F.sequence(band(lowest), band(F.col("reach")))))
    # Those of a shingle's largest component are never met with each other.
    near = small(met.where("not within")).join(large(met), ["item", "band"]).unionByName(small(met.where("within")).join(large(met.where("not within")), ["item", "band"]))
    near = near.where("c1 <> c2 and (n1 < n2 or n1 = n2 and doc_id1 < doc_id2)").where((100 + SIMILAR) * F.least("after1", "after2") >= SIMILAR * (F.col("n1") + F.col("n2")))
    return near.select(F.least("doc_id1", "doc_id2").alias("a"), F.greatest("doc_id1", "doc_id2").alias("b")).distinct()


def _residual(members: DataFrame, found: DataFrame, bits: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of members(key, doc_id) of one bucket and different components that may be near; all that are similar are among them.

    CROWD, and the number of shingles in a bucket, only choose how they are found: by comparison, or in crowded buckets by shared shingles.
    """
    rest = _mixed(members, found)
    sizes = _among(bits.select("doc_id", "n"), rest.select("doc_id").distinct()).groupBy("doc_id").agg(F.min("n").alias("n"))
    full = rest.join(sizes, "doc_id").groupBy("key").agg((F.max("outside") > F.least(F.lit(CROWD), F.floor(F.avg("n")))).alias("crowded"))
    rest = cut(rest.drop("outside").join(full, "key"), "residual", True)
    some = rest.where("not crowded").drop("crowded")
    near = _near_enough(_across(some.join(_among(bits, some.select("doc_id").distinct()), "doc_id")))
    out = near.select(F.least("doc_id1", "doc_id2").alias("a"), F.greatest("doc_id1", "doc_id2").alias("b"))
    crowd = cut(rest.where("crowded").select("doc_id", "c").distinct(), "crowd", True)
    if not crowd.isEmpty():
        out = out.unionByName(_sized(cut(_by_prefix(crowd, texts), "by-prefix", True), _among(bits, crowd.select("doc_id"))))
    return out.distinct()


def _sized(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Those of pairs(a, b) that sizes and parities don't prove too far apart; held(doc_id, n, bits) has all their members."""
    side = lambda i, key: held.select(F.col("doc_id").alias(key), F.col("n").alias(f"n{i}"), F.col("bits").alias(f"bits{i}"))
    return _near_enough(pairs.join(side(1, "a"), "a").join(side(2, "b"), "b")).select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(map_arrow(texts, _sign, "doc_id long, n_shingles long, digest binary, keys array<bigint>, bits array<bigint>"), "signed")
    linked = signed.where("doc_id is not null and digest is not null")
    classes = cut(linked.groupBy("digest").agg(F.min("doc_id").alias("a")), "sets", True)
    same = linked.select("digest", F.col("doc_id").alias("b")).join(classes, "digest").where("a <> b").select("a", "b")
    members = linked.join(classes, "digest").where("doc_id = a").groupBy("doc_id", "digest").agg(F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    members = members.select("doc_id", F.col("n").cast("int").alias("n"), F.explode("keys").alias("key"))
    drawn = F.struct(F.xxhash64("doc_id").alias("draw"), "doc_id", "n")
    hubs = members.groupBy("key").agg(F.array(F.min(drawn), F.max(drawn)).alias("hubs"), F.count("*").alias("size")).where("size > 1").select("key", "hubs")
    met = cut(members.join(hubs, "key").select("key", "doc_id", "n", "hubs"), "buckets", True)
    bits = linked.select("doc_id", F.col("n_shingles").alias("n"), "bits")
    near = F.filter("hubs", lambda h: (h["doc_id"] != F.col("doc_id")) & (100 * F.least(h["n"], F.col("n")) >= SIMILAR * F.greatest(h["n"], F.col("n"))))
    pairs = met.select("doc_id", F.explode(near["doc_id"]).alias("hub")).select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct()
    pairs = cut(pairs, "hub-met", True)
    pairs = cut(_sized(pairs, _among(bits, _ends(pairs))), "hub-pairs", True)
    links = cut(_confirmed(pairs, texts), "hub-links", True)
    found = components(links)
    more = _residual(met.select("key", "doc_id"), found, bits, texts).join(pairs, ["a", "b"], "left_anti")
    more = cut(_confirmed(cut(more, "more-pairs", True), texts), "more-links", True)
    found = components(links.unionByName(more).unionByName(same))
    out = signed.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
