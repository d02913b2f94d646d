"""Burrows-Wheeler transform and common prefixes of a collection of strings, built column by column.

Round j puts in the suffix of length j of every string that has one, from the strings' ends to
their beginnings. The transform holds, for each suffix put in so far, in order of the suffixes,
the symbol in front of it. A new suffix c + s stands behind all suffixes that begin with a smaller
symbol and behind as many that begin with c as there are c in the transform in front of s. Its
common prefix with the suffix before it is one more than the least common prefix between s and
the last c in front of s, or nothing where there is no such c; the one behind it likewise.
A round reads and writes the columns from front to back. A collection is of bounded size, so the columns are
arrays of a task and not files.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

END = 0  # in front of a whole string; symbols are bytes plus one


class Sorted(NamedTuple):
    """All suffixes in order: their string, their length and their common prefix with the one before."""

    string: np.ndarray
    length: np.ndarray
    common: np.ndarray


def _least(common: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of common[low : high + 1] for each pair; low <= high."""
    if not len(low):
        return np.zeros(0, common.dtype)
    ends = np.stack([low, high + 1], axis=1).ravel()
    return np.minimum.reduceat(np.append(common, common.dtype.type(0)), ends)[::2]


def build(data: np.ndarray, size: np.ndarray) -> Sorted:
    """data: the bytes of all strings, one after the other; size: of each. Sizes are below 2**16."""
    m, data = len(size), np.append(data, np.uint8(0))
    last = np.cumsum(size)
    symbol = lambda strings, taken: np.where(taken < size[strings], data[np.maximum(last[strings] - taken - 1, 0)].astype(np.int16) + 1, END).astype(np.int16)
    everyone = np.arange(m)
    suffix, common = everyone.astype(np.int64) << 16, np.zeros(m, np.uint16)  # string, and length in the last 16 bits
    front = symbol(everyone, np.zeros(m, np.int64))
    at = everyone.copy()
    for j in range(1, int(size.max(initial=0)) + 1):
        active = np.flatnonzero(size >= j)
        place = at[active]
        # Where each suffix goes once its symbol is put in front of it: whole strings have none.
        order = np.argsort(front, kind="stable")
        whole = int((front == END).sum())
        rank = np.empty(len(front), np.int64)
        rank[order] = np.arange(len(front))
        mine = rank[place]
        c = front[place]
        padded = np.concatenate([[-1], order, [-1]])
        before, after = padded[mine], padded[mine + 2]
        has_before = (before >= 0) & (front[before] == c)
        has_after = (after >= 0) & (front[after] == c)
        lcp_before = np.zeros(len(active), np.uint16)
        lcp_before[has_before] = 1 + _least(common, before[has_before] + 1, place[has_before])
        lcp_after = np.zeros(len(active), np.uint16)
        lcp_after[has_after] = 1 + _least(common, place[has_after] + 1, after[has_after])

        new = m + mine - whole
        n = len(front) + len(active)
        old = np.ones(n, bool)
        old[new] = False
        kept = np.flatnonzero(old)
        out = [np.empty(n, x.dtype) for x in (suffix, common, front)]
        for column, values in zip(out, (suffix, common, front), strict=True):
            column[kept] = values
        suffix, common, front = out
        follows = new + 1 < n
        common[new[follows] + 1] = lcp_after[follows]
        common[new] = lcp_before  # of neighbours that are both new, each has its own
        suffix[new], front[new] = (active << 16) + j, symbol(active, np.full(len(active), j))
        at[active] = new
    return Sorted(suffix >> 16, suffix & 0xFFFF, common)


def equal_strings(found: Sorted, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, group) of all substrings of `length` bytes; equal ones share a group number."""
    long = found.length >= length
    # A shorter suffix between two long ones ends their common prefix below `length`.
    lowest = np.where(found.common >= length, 0, 1)
    group = np.cumsum(lowest)[long]
    string = found.string[long]
    return string, size[string] - found.length[long], group
