"""Byte-level BPE, encoding and decoding, with vectorised pre-tokenisation.

Texts become arrays of code-point classes. Where a piece begins depends on what came before only
through a small automaton (is a run of letters, digits or other signs open, does it hang on
a space, how many letters of a contraction are left), whose transition functions compose associatively:
each lane of code points first gives its function from any state to its last, a scan over lanes
composes them, and a second pass from the right states marks the boundaries. No regular expression runs.

Distinct slices between boundaries are merged once in a chunk (all of them in step, as arrays) and kept,
by their bytes, in a bounded cache with their ids, the text of their ids and their decoded bytes.

Defined results: null text is empty; empty text has no token and decodes to nothing; every
row gets its own result, equal doc_ids too; bytes that aren't UTF-8 count as U+FFFD; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import map_arrow

#: Bytes of text pre-tokenised at once: more repeat within more, but what a worker holds grows with it.
PRETOKENISED = 1 << 19
#: Entries of a task's cache of merged pieces, which starts anew when full, and the longest piece that stays in it.
CACHE, KEPT = 60_000, 256
#: Pieces longer than this are merged one by one.
WIDE = 48

# Symbols of the automaton: what a code point is, as far as boundaries go.
LETTER, NUMBER, SPACE, OTHER_SPACE, SIGN, SHORT, LONG = range(7)  # SHORT and LONG: an apostrophe before s t m d, before re ve ll
# States: what is open after a code point.
FREE, AFTER_SPACE, LETTERS, NUMBERS, SIGNS, TWO_LEFT, ONE_LEFT, ENDED = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, by symbol (+ 7 at the start of a text) and state. White space has its boundaries set later."""
    go, begins = np.zeros((14, 8), np.uint8), np.zeros((14, 8), bool)
    run = {LETTER: LETTERS, NUMBER: NUMBERS, SIGN: SIGNS}
    for symbol in range(14):
        for held in range(8):
            state, kind = (FREE, symbol - 7) if symbol >= 7 else (held, symbol)
            if kind in (SPACE, OTHER_SPACE):
                go[symbol, held] = AFTER_SPACE if kind == SPACE else FREE
            elif kind in (SHORT, LONG) and state not in (SIGNS, AFTER_SPACE):
                go[symbol, held], begins[symbol, held] = ONE_LEFT if kind == SHORT else TWO_LEFT, True
            elif kind == LETTER and state in (TWO_LEFT, ONE_LEFT):
                go[symbol, held] = ONE_LEFT if state == TWO_LEFT else ENDED
            else:
                to = run.get(kind, SIGNS)
                go[symbol, held], begins[symbol, held] = to, state not in (AFTER_SPACE, to)
    return go, begins


GO, BEGINS = _automaton()
#: White_Space of Unicode.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The symbol of every code point."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        _classes = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], SIGN) for i in range(0x110000)), np.uint8, 0x110000)
        _classes[WHITE] = OTHER_SPACE
        _classes[0x20] = SPACE
    return _classes


def states(symbols: np.ndarray, lane: int = 256) -> np.ndarray:
    """The state before each symbol, by a scan over lanes."""
    n = len(symbols)
    lanes = -(-n // lane)
    padded = np.full(lanes * lane, OTHER_SPACE, np.uint8)
    padded[:n] = symbols
    grid = np.ascontiguousarray(padded.reshape(lanes, lane).T)
    flat = GO.ravel()
    whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], lanes, 1)  # each lane's function: state at its start -> at its end
    for row in grid:
        whole = flat[row.astype(np.int16) * 8 + whole]
    step = 1
    while step < lanes:  # associative: compose with the function of the lanes before
        whole[:, step:] = np.take_along_axis(whole[:, step:], whole[:, :-step].copy(), 0)
        step *= 2
    state = np.zeros(lanes, np.uint8)
    state[1:] = whole[FREE, :-1]
    out = np.empty((lane, lanes), np.uint8)
    for i, row in enumerate(grid):
        out[i] = state
        state = flat[row.astype(np.int16) * 8 + state]
    return out.T.ravel()[:n]


def piece_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points begin a piece; first: those that begin a text."""
    n = len(codes)
    symbols = classes()[codes]
    apostrophe = np.flatnonzero(codes == 0x27)
    if len(apostrophe):
        padded = np.zeros(n + 2, codes.dtype)
        padded[:n] = codes
        edge = np.ones(n + 2, bool)
        edge[:n] = first
        a, b = np.where(edge[apostrophe + 1], 0, padded[apostrophe + 1]), padded[apostrophe + 2]
        b = np.where(edge[np.minimum(apostrophe + 2, n + 1)], 0, b)
        symbols[apostrophe[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
        pairs = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        symbols[apostrophe[pairs]] = LONG
    white = (symbols == SPACE) | (symbols == OTHER_SPACE)
    marked = symbols + np.where(first, 7, 0).astype(np.uint8)
    starts = BEGINS.ravel()[marked.astype(np.int16) * 8 + states(marked)]
    before = np.zeros(n, bool)
    before[1:] = white[:-1]
    before &= ~first
    last = np.zeros(n, bool)  # the last of a run of white space that something follows
    last[:-1] = white[:-1] & ~white[1:] & ~first[1:]
    starts |= white & (~before | last)
    return starts


class Encoder:
    """Merges by rank, for many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, made = [], [], []
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                if (a := ranks.get(piece[:i])) is not None and (b := ranks.get(piece[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys)
        self.size = 1 << 20
        self.slot_key, self.slot_rank = np.full(self.size, -1, np.int64), np.full(self.size, 2**31 - 1, np.int32)
        keys, made = keys[order], np.array(made, np.int32)[order]
        slots = self.slots(keys)
        rest = np.arange(len(keys))
        while len(rest):  # open addressing
            at = slots[rest]
            free = self.slot_key[at] == -1
            _, one = np.unique(at, return_index=True)
            takes = np.zeros(len(rest), bool)
            takes[one] = True
            takes &= free
            self.slot_key[at[takes]], self.slot_rank[at[takes]] = keys[rest[takes]], made[rest[takes]]
            rest = rest[~takes]
            slots[rest] = (slots[rest] + 1) & (self.size - 1)
        self.cache: dict[bytes, tuple[int, bytes, bytes]] = {}

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges to, a large number where there is none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self.slots(keys)
        held = self.slot_key[at]
        out = np.where(held == keys, self.slot_rank[at], 2**31 - 1)
        rest = np.flatnonzero((held != keys) & (held != -1))
        while len(rest):
            at[rest] = (at[rest] + 1) & (self.size - 1)
            held = self.slot_key[at[rest]]
            out[rest[held == keys[rest]]] = self.slot_rank[at[rest[held == keys[rest]]]]
            rest = rest[(held != keys[rest]) & (held != -1)]
        return out

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece: in every round each piece merges its pair of least rank, the leftmost of them."""
        out: list[list[int] | None] = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = [rank]
            elif len(piece) > WIDE:
                out[i] = self.merge_long(piece)
            else:
                by_width.setdefault(-(-len(piece) // 4) * 4, []).append(i)
        for width, rows in by_width.items():
            lengths = np.array([len(pieces[i]) for i in rows])
            grid = np.zeros((len(rows), width), np.int32)
            inside = np.arange(width)[None, :] < lengths[:, None]
            grid[inside] = self.single[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
            ids, at = grid, np.array(rows)
            count = lengths
            ranks = np.full((len(rows), width - 1), 2**31 - 1, np.int32)
            pairs = np.arange(width - 1)[None, :] < (count - 1)[:, None]
            ranks[pairs] = self.pair_ranks(ids[:, :-1][pairs], ids[:, 1:][pairs])
            while True:
                best = ranks.argmin(1)
                rank = ranks[np.arange(len(at)), best]
                done = rank == 2**31 - 1
                if done.any():
                    for i, row, n in zip(at[done].tolist(), ids[done].tolist(), count[done].tolist(), strict=True):
                        out[i] = row[:n]
                    on = ~done
                    ids, at, count, ranks, best, rank = ids[on], at[on], count[on], ranks[on], best[on], rank[on]
                if not len(at):
                    break
                k = np.arange(len(at))
                ids[k, best] = rank
                # drop the merged pair's right token: everything after it moves one place to the left
                cols = np.arange(width)[None, :]
                source = np.minimum(cols + (cols > best[:, None]), width - 1)
                ids = np.take_along_axis(ids, source, 1)
                cols = np.arange(width - 1)[None, :]
                source = np.minimum(cols + (cols > best[:, None]), width - 2)
                moved = np.take_along_axis(ranks, source, 1)
                count = count - 1
                moved[cols >= (count - 1)[:, None]] = 2**31 - 1
                left = best > 0
                moved[k[left], best[left] - 1] = self.pair_ranks(ids[k[left], best[left] - 1], ids[k[left], best[left]])
                right = best < count - 1
                moved[k[right], best[right]] = self.pair_ranks(ids[k[right], best[right]], ids[k[right], best[right] + 1])
                ranks = moved
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """The same for one long piece: a heap of pairs over a linked list."""
        import heapq

        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        found = self.pair_ranks(np.array(ids[:-1]), np.array(ids[1:]))
        near = np.flatnonzero(found < 2**31 - 1)
        heap = [(int(found[i]), i, ids[i], ids[i + 1]) for i in near.tolist()]
        heapq.heapify(heap)
        ranks, bytes_of, alive = self.ranks, self.bytes_of, [True] * n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], alive[j] = rank, False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(bytes_of[rank] + bytes_of[ids[k]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(bytes_of[ids[h]] + bytes_of[rank])) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x, on in zip(ids, alive, strict=True) if on]

    def pieces(self, raw: bytes, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, bytes, bytes]], np.ndarray]:
        """Starts of the pieces (bytes), which distinct piece each is, the distinct ones' (n ids, ids as text, decoded bytes) and the rows' offsets among pieces."""
        lead = (data & 0xC0) != 0x80
        at_byte = np.flatnonzero(lead)
        codes = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        begins = np.zeros(len(data) + 1, bool)
        begins[at] = True
        starts = at_byte[piece_starts(codes, begins[at_byte])]
        ends = np.append(starts[1:], len(data))
        one, which = vec.first_of_equal(data, starts, ends)
        keys, cache = [raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)], self.cache
        new = [key for key in keys if key not in cache]
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = keys
        for key, ids in zip(new, self.merge_all(new), strict=True):
            cache[key] = (len(ids), "".join(f"{x}," for x in ids).encode(), b"".join([self.bytes_of[x] for x in ids]))
        found = [cache[key] for key in keys]
        for key in new:
            if len(key) > KEPT:
                del cache[key]
        return starts, which, found, np.searchsorted(starts, at)


def read_ranks(lines: Iterator[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        with open(path, "rb") as f:
            _encoders[path] = Encoder(read_ranks(f))
    return _encoders[path]


def _encode(name: str, with_ids: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SparkFiles.get(name))
        try:
            for batch in batches:
                counts, ids, hashes, decoded = [], [], [], []
                for lo, hi, data, at in vec.chunks(batch, size=PRETOKENISED):
                    if not len(data):
                        texts, backs, sums, of = [], [], np.zeros(1, np.int64), np.zeros(hi - lo + 1, np.int64)
                    else:
                        _, which, distinct, of = own.pieces(data.tobytes(), data, at)
                        sums = np.concatenate([[0], np.cumsum(np.array([x[0] for x in distinct])[which])])
                        order = which.tolist()
                        says, back = [x[1] for x in distinct], [x[2] for x in distinct]
                        texts, backs = [says[i] for i in order], [back[i] for i in order]
                    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
                        said = b"".join(texts[a:b])[:-1]
                        counts.append(int(sums[b] - sums[a]))
                        hashes.append(hashlib.sha256(said).hexdigest())
                        decoded.append(hashlib.sha256(b"".join(backs[a:b])).hexdigest())
                        if with_ids:
                            ids.append(np.array(said.split(b",") if said else [], np.int32))
                out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)
        finally:
            own.cache.clear()  # the worker may go on with other stages

    return encode


def _send(df: DataFrame, path: str) -> str:
    """The vocabulary goes to every executor as a file of the job; its size is fixed."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, ranks_path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of each row of docs(doc_id, text)."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8(F.col("text").cast("string")).alias("text")), _encode(_send(docs, ranks_path), with_ids), schema)


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the decoded bytes of each row of tokens(doc_id, ids); ends[i] is where the bytes of ids[i] end."""
    name = _send(tokens, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = encoder(SparkFiles.get(name)).bytes_of
        for batch in batches:
            parts = [[bytes_of[i] for i in ids or []] for ids in batch.column(1).to_pylist()]
            ends = [np.cumsum([len(x) for x in p], dtype=np.int64) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(p) for p in parts], pa.binary()), pa.array(ends, pa.list_(pa.int64()))], ["doc_id", "bytes", "ends"])

    return map_arrow(tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), run, "doc_id long, bytes binary, ends array<bigint>")
