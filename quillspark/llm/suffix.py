"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai's common prefixes, merging by binary search."""

from __future__ import annotations

import numpy as np

#: Symbols in a first key: 9 bits each, so that an end differs from every byte.
FIRST = 7


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffixes of several texts, in order, as positions in their concatenation.

    text: symbols 1..256; ends: for each position, the end of the text that it is in. A
    suffix ends with its text, and one that is a prefix of others comes first; equal ones
    are in order of position. As with Larsson and Sadakane, suffixes are ordered by their
    first symbols, ranks name groups of equal ones, and each round orders every group that
    is not yet one suffix by the rank of what follows, which doubles the known depth.
    """
    n = len(text)
    at = np.arange(n)
    left = ends - at
    key = np.zeros(n, dtype=np.int64)
    for j in range(FIRST):
        s = np.zeros(n, dtype=np.int64)
        s[: n - j] = text[j:]
        key = key << 9 | np.where(left > j, s, 0)
    sa = np.argsort(key, kind="stable")
    k = key[sa]
    new = np.r_[True, k[1:] != k[:-1]]
    rank = np.empty(n, dtype=np.int64)
    # a group's rank is the place of its first suffix, so ranks of finished groups never change
    rank[sa] = np.maximum.accumulate(np.where(new, at, 0))
    depth, longest = FIRST, int(left.max(initial=0))
    open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))
    while len(open_) and depth < longest:
        pos = sa[open_]
        r = rank[pos]
        nxt = np.where(left[pos] > depth, rank[np.minimum(pos + depth, n - 1)] + 1, 0)
        o = np.argsort(r * (n + 1) + nxt, kind="stable")
        pos, r, nxt = pos[o], r[o], nxt[o]
        sa[open_] = pos  # groups are contiguous, so the sorted order fills the same places
        head = np.r_[True, (r[1:] != r[:-1]) | (nxt[1:] != nxt[:-1])]
        place = np.maximum.accumulate(np.where(head, open_, 0))
        rank[pos] = place
        single = head & np.r_[head[1:], True]
        open_ = open_[~single]
        depth *= 2
    if len(open_):  # whole suffixes are equal; each text's own end sets them apart, in order of position
        pos = sa[open_]
        sa[open_] = pos[np.lexsort((pos, rank[pos]))]
    return sa


def common_prefixes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of sa, the common prefix with the place before (0 at the first), by Kasai's algorithm.

    starts, ends: of each text. All texts are walked at once: in a step each text either
    lengthens the match at its position or goes on to its next position, of which the
    match is at least one shorter.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    end_of = np.repeat(ends, ends - starts)
    plcp = np.zeros(n, dtype=np.int64)
    pos, stop = starts.astype(np.int64).copy(), ends.astype(np.int64)
    length = np.zeros(len(pos), dtype=np.int64)
    while len(pos):
        j = before[pos]
        a, b = pos + length, j + length
        ok = (j >= 0) & (a < stop)
        ok &= b < end_of[np.maximum(j, 0)]
        same = ok.copy()
        same[ok] = text[a[ok]] == text[b[ok]]
        over = ~same
        plcp[pos[over]] = length[over]
        length = np.where(same, length + 1, np.maximum(length - 1, 0))
        pos = pos + over
        alive = pos < stop
        if not alive.all():
            pos, stop, length = pos[alive], stop[alive], length[alive]
    return plcp[sa]


def in_others(merged: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key of one array is in the sorted keys of all arrays more than once: by binary search."""
    return np.searchsorted(merged, keys, "right") - np.searchsorted(merged, keys, "left") > 1
