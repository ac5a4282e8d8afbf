"""Suffix arrays and common prefixes of one shard of text segments, in numpy.

A shard is an array of symbols: every segment's bytes plus one, then a zero that
ends it. Ends differ from each other and come before all bytes, so no two
suffixes are equal and no prefix passes a segment's end.
"""

from __future__ import annotations

import numpy as np

FIRST = 7


def shard(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, start of each segment, position of the end of each position's segment)."""
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))
    symbols = np.zeros(int(starts[-1]), np.uint64)
    ends = np.repeat(starts[1:] - 1, lengths + 1)
    symbols[np.arange(len(symbols)) != ends] = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint64) + np.uint64(1)
    return symbols, starts[:-1], ends


def suffix_array(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by Larsson-Sadakane refinement.

    Suffixes are grouped by their first seven symbols. Each round sorts the
    suffixes of every group that isn't a single one by the group of the suffix h
    further on, and h doubles. Groups of one aren't touched again.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    position = np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(FIRST):
        at = position + k
        key = (key << np.uint64(9)) | np.where(at < ends, symbols[np.minimum(at, n - 1)], np.uint64(0))
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    # what ends within the key differs from all others by its end
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) | (ends[sa] - sa < FIRST)
    group = np.empty(n, np.int64)
    group[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
    h = FIRST
    while True:
        open_ = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
        if not len(open_):
            return sa
        at = sa[open_]
        pair = (group[at] << 32) | group[at + h]
        order = np.argsort(pair, kind="stable")
        sa[open_] = at[order]
        pair = pair[order]
        new[open_] |= np.concatenate(([True], pair[1:] != pair[:-1]))
        group[sa[open_]] = np.flatnonzero(new)[np.cumsum(new)[open_] - 1]
        h *= 2


def common_prefixes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in sa and the one before it.

    Kasai's walk: a position's prefix is at most one symbol shorter than that of
    the position before it. Segments are walked side by side, one position of
    each at a step, the longest first.
    """
    n = len(symbols)
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    out = np.zeros(n, np.int64)
    length = ends[starts] - starts
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    h = np.zeros(len(starts), np.int64)
    for t in range(int(length.max(initial=0))):
        k = int(np.searchsorted(-length, -t, side="left"))
        i = starts[:k] + t
        h = np.maximum(h[:k] - 1, 0)
        r = rank[i]
        j = sa[np.maximum(r - 1, 0)]
        most = np.where(r > 0, np.minimum(length[:k] - t, ends[j] - j), 0)
        walking = np.flatnonzero(h < most)
        while len(walking):
            walking = walking[symbols[i[walking] + h[walking]] == symbols[j[walking] + h[walking]]]
            h[walking] += 1
            walking = walking[h[walking] < most[walking]]
        out[r] = h
    return out
