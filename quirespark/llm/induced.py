"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Suffixes are classed as smaller (S) or larger (L) than the next; the leftmost S of each stretch (LMS)
cut the text into substrings. These are sorted by induction, named by comparison with their neighbours, and
sorted as suffixes of the string of their names, by the same routine, until all names differ; the
order of all suffixes is then induced from theirs. Induction goes once through the array in each direction, over
plain lists, in linear time whatever the alphabet; classing, naming and prefixes are numpy's.
"""

from __future__ import annotations

import numpy as np


def _induce(t: list[int], small: list[bool], lms: list[int], first: np.ndarray) -> np.ndarray:
    """The suffix array if lms are in order; if only their first symbols are, the order of the LMS substrings."""
    sa = [0] * len(t)
    tail = first[1:].tolist()
    for i in reversed(lms):
        tail[t[i]] -= 1
        sa[tail[t[i]]] = i
    head = first[:-1].tolist()
    sa[0] = len(t) - 1  # the sentinel
    for i in sa:  # larger ones, among them those that are only now put further on
        if i and not small[i - 1]:
            c = t[i - 1]
            sa[head[c]] = i - 1
            head[c] += 1
    tail = first[1:].tolist()
    for k in range(len(t) - 1, -1, -1):
        i = sa[k]
        if i and small[i - 1]:
            c = t[i - 1]
            tail[c] -= 1
            sa[tail[c]] = i - 1
    sa[0] = len(t) - 1
    return np.array(sa)


def _names(t: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each of the substrings t[order[i]:ends[i]], which are sorted: equal ones get the same."""
    length = ends - order
    same = length[1:] == length[:-1]
    near = np.flatnonzero(same)
    n = length[near]
    if len(near):
        edge = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(order[near] - edge, n)
        shift = np.repeat(order[near + 1] - order[near], n)
        same[near] = np.logical_and.reduceat(t[at] == t[at + shift], edge)
    return np.concatenate([[0], np.cumsum(~same)])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of text in their order.

    text: small integers, the last one 0 and the only 0.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    change = np.flatnonzero(text[1:] != text[:-1])
    next_change = np.repeat(change, np.diff(np.concatenate([[-1], change])))
    small = np.ones(n, bool)
    small[: n - 1] = text[next_change] < text[next_change + 1]
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(np.bincount(text))])
    t, classes = text.tolist(), small.tolist()
    sa = _induce(t, classes, lms[np.argsort(text[lms], kind="stable")].tolist(), first)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    ends = np.full(n, n)
    ends[lms[:-1]] = lms[1:] + 1
    name = np.empty(n, np.int64)
    name[order] = _names(text, order, ends[order])
    if name[order[-1]] < len(order) - 1:  # some are equal; the sentinel's name is 0
        order = lms[suffix_array(name[lms])]
    return _induce(t, classes, order.tolist(), first)


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix, the length of its common prefix with the one before it in the order.

    Only where the symbols before both differ (irreducible values) are symbols compared, eight
    at a time; all other values are one less than that of the suffix one place to the left.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([text.astype(np.uint64), np.zeros(16, np.uint64)])
    word = np.zeros(n + 8, np.uint64)
    for i in range(7):  # symbols are under 512: seven of 9 bits
        word = word << np.uint64(9) | padded[i : i + n + 8]
    at = np.arange(n)
    alone = (before < 1) | (at < 1)
    alone[~alone] = text[at[~alone] - 1] != text[before[~alone] - 1]
    places = np.flatnonzero(alone & (before >= 0))
    out = np.zeros(n, np.int64)
    a, b, live = places, before[places], places
    while len(live):
        x = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
        same = x == 0
        stop = live[~same]
        # symbols that agree before the first that differs
        high = np.floor(np.log2(x[~same].astype(np.float64) + 0.5)).astype(np.int64)
        high -= (x[~same] >> high.astype(np.uint64)) == 0
        out[stop] += (62 - high) // 9
        out[live[same]] += 7
        a, b, live = a[same] + 7, b[same] + 7, live[same]
    value = np.where(alone, out + at, 0)
    return np.maximum.accumulate(value) - at
