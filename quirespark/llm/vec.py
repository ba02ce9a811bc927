"""Vector text primitives: whole Arrow batches of UTF-8 are cut into words and hashed with numpy.

Positions are byte offsets into a chunk, the concatenated texts of consecutive rows.
All separators used here are ASCII, so cutting bytes and cutting code points agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is a chunk of its own.
CHUNK = 1 << 19

_all = np.arange(256)
#: Bytes of words `[^\x20\x09-\x0D]+`.
NONSPACE = ~((_all == 0x20) | ((_all >= 0x09) & (_all <= 0x0D)))
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, once A-Z are lower case.
ALNUM = ((_all >= 0x30) & (_all <= 0x39)) | ((_all >= 0x61) & (_all <= 0x7A)) | (_all >= 0x80)
LOWER = np.where((_all >= 0x41) & (_all <= 0x5A), _all + 32, _all).astype(np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 1 << 16)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]) for b in (self.base, self.inverse))
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)


POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers; span() turns two of them into the hash of what lies between."""
    n = len(values)
    POWERS.need(n)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(values * POWERS.up[:n], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each values[start:end]: equal spans have equal hashes wherever they lie."""
    h = sums[end]
    h -= sums[start]
    h *= POWERS.down[start]
    h += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


#: 2^61 - 1, a prime: polynomials modulo it have no texts that collide by construction, as those modulo 2^64 do.
PRIME = (1 << 61) - 1
_P, _LOW30, _LOW31, _LOW60 = (np.uint64((1 << k) - 1) for k in (61, 30, 31, 60))
#: Values handled at once, so that the steps of a product stay in the processor's cache.
BLOCK = 1 << 14


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of values below it."""
    a1, b1 = a >> np.uint64(31), b >> np.uint64(31)
    a0, b0 = a & _LOW31, b & _LOW31
    middle = a1 * b0
    middle += a0 * b1
    out = a1 * b1
    out <<= np.uint64(1)
    out += middle >> np.uint64(30)
    out += (middle & _LOW30) << np.uint64(31)
    out += a0 * b0
    return _reduced(out)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(2, n), np.uint64)
    have = 1
    while have < len(out):  # the second half is the first times the power in between
        more = min(have, len(out) - have)
        out[have : have + more] = _product(out[:more], np.full(more, pow(base, have, PRIME), np.uint64))
        have += more
    return out


_prime_up = _prime_down = np.ones(1, np.uint64)
_PRIME_BASE = 0x9E3779B97F4A7C15 % PRIME


def exact_prefix(data: np.ndarray) -> np.ndarray:
    """prefix() of bytes modulo PRIME."""
    global _prime_up, _prime_down
    n = len(data)
    if len(_prime_up) <= n:
        _prime_up, _prime_down = (_powers(b, max(n + 1, 1 << 16)) for b in (_PRIME_BASE, pow(_PRIME_BASE, -1, PRIME)))
    out = np.zeros(n + 1, np.uint64)
    carry = np.uint64(0)
    for i in range(0, n, BLOCK):
        term = _product(_BYTE[data[i : i + BLOCK]] & _LOW60, _prime_up[i : min(n, i + BLOCK)])
        low, high = np.cumsum(term & _LOW31), np.cumsum(term >> np.uint64(31))
        sums = _reduced((high >> np.uint64(30)) + ((high & _LOW30) << np.uint64(31)) + low)
        out[i + 1 : i + 1 + len(term)] = _reduced(sums + carry)
        carry = out[i + len(term)]
    return out


def exact_span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """span() over exact_prefix(): two different spans of n bytes are equal with a probability of n / 2^61 over the choice of the base."""
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(start), BLOCK):
        a, b = start[i : i + BLOCK], end[i : i + BLOCK]
        h = _product(_reduced(sums[b] + (_P - sums[a])), _prime_down[a])
        h += (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out[i : i + BLOCK] = mix(h)
    return out


def first_of_equal(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one, which): spans data[start:end] that are all different, and which of them each span is.

    Hashes gather what may be equal, bytes decide.
    """
    _, one, which = np.unique(span(prefix(byte_values(data)), start, end), return_index=True, return_inverse=True)
    lead = one[which]
    length = end - start
    same = length == length[lead]
    shown = np.flatnonzero(same & (lead != np.arange(len(start))))
    n = length[shown]
    if len(shown) and n.sum():
        full = shown[n > 0]
        n = length[full]
        shift = np.repeat(start[lead[full]] - start[full], n)
        edge = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(edge - start[full], n)
        same[full] &= np.logical_and.reduceat(data[at] == data[at + shift], edge)
    odd = np.flatnonzero(~same)
    if len(odd):  # spans of one hash that differ: they are told apart one by one
        raw, held, more = data.tobytes(), {}, []
        for i in odd.tolist():
            text = raw[start[i] : end[i]]
            if text not in held:
                held[text] = len(one) + len(more)
                more.append(i)
            which[i] = held[text]
        one = np.concatenate([one, more])
    return one, which


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK):
    """(first row, last row + 1, bytes, offsets of the rows' texts in them); nulls are empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the offsets of the rows' words among them."""
    n = len(data)
    inside = table[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    edge[0] = edge[n] = True
    before, after = edge.copy(), edge
    before[1:n] |= ~inside[:-1]
    after[1:n] |= ~inside[1:]
    start = np.flatnonzero(inside & before[:n])
    end = np.flatnonzero(inside & after[1:]) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal for equal words; some words that differ share a hash, so that it gathers and selects, but doesn't decide."""
    return span(prefix(byte_values(data)), start, end)


def joined_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words with one space after each, and where each begins there (and the end)."""
    at = np.concatenate([[0], np.cumsum(end - start + 1)])
    if not len(start):
        return b"", at
    out = data[np.minimum(np.arange(at[-1]) + np.repeat(start - at[:-1], end - start + 1), len(data) - 1)]
    out[at[1:] - 1] = 0x20
    return out.tobytes(), at


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position; the last k - 1 positions have none."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += hashes[i : i + n]
    return mix(out)
