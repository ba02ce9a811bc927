"""Where equal windows can be: content-chosen anchors, the same in every copy of a window.

A window is `window` consecutive symbols of one text. Its anchor is the k-gram in it of the smallest
hash, the leftmost of equal ones, so equal windows have equal anchors at equal places. A run is the
maximal range of a text's windows with one anchor place; its context is the symbols that its windows cover.
Windows in runs of different anchors differ.
"""

from __future__ import annotations

import numpy as np

from . import vec


def sliding_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive keys."""
    have, low = 1, keys
    while have * 2 <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    return low


def runs(symbols: np.ndarray, of: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window + 1, anchor hash, place of the anchor from the first window) of the runs of the texts symbols[of[i]:of[i+1]].

    symbols: 64-bit values, equal where symbols are equal. Positions are those in symbols.
    """
    n = len(symbols)
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty, empty.astype(np.uint64), empty
    sums = vec.prefix(symbols)
    at = np.arange(n - k + 1)
    gram = vec.span(sums, at, at + k)
    keys = (gram >> np.uint64(24) << np.uint64(24)) | (at.astype(np.uint64) & np.uint64((1 << 24) - 1))  # ties: the leftmost
    low = sliding_minimum(keys, window - k + 1)
    first = np.arange(len(low))
    # the place of the anchor, from its low bits: it is less than a window ahead
    place = first + ((low - first.astype(np.uint64)) & np.uint64((1 << 24) - 1)).astype(np.int64)
    ends = of[1:]
    room = ends - window - of[:-1] + 1
    inside = np.zeros(len(low) + 1, np.int32)
    full = room > 0
    np.add.at(inside, of[:-1][full], 1)
    np.add.at(inside, of[:-1][full] + room[full], -1)
    inside = np.cumsum(inside[:-1]) > 0
    begin = inside.copy()
    begin[1:] &= ~(inside[:-1] & (place[1:] == place[:-1]))
    edge = np.zeros(len(low), bool)
    edge[of[:-1][full]] = True
    begin |= edge & inside
    lo = np.flatnonzero(begin)
    stop = np.append(lo[1:], len(low))
    # windows between two runs belong to no text: a run ends with its text
    text = np.searchsorted(of, lo, "right") - 1
    hi = np.minimum(stop, ends[text] - window + 1)
    return lo, hi, gram[place[lo]], place[lo] - lo
