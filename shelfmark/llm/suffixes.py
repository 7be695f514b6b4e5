"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, binary search.

Sequences are integer arrays in which 0 ends a piece; every array is padded by
the caller's helper so that a look ahead never leaves it.
"""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray, places: np.ndarray, key: np.ndarray, known: int, depth: int) -> np.ndarray:
    """Suffixes starting at ``places``, in order of their first ``depth`` symbols.

    ``key`` orders them by their first ``known`` symbols. Each round doubles the
    sorted length by pairing a suffix's rank with that of the suffix ``known``
    further on; only suffixes that still share a rank are sorted again.
    Symbols 0 compare as smallest and equal; ties after ``depth`` symbols come
    in any order.
    """
    count = len(places)
    by = np.argsort(key)
    order, sorted_key = places[by], key[by]
    head = np.empty(count, bool)
    head[:1] = True
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.zeros(len(seq) + 2 * depth + 2, np.int64)
    group = np.maximum.accumulate(np.where(head, np.arange(count), 0))
    rank[order] = group + 1
    while known < depth and count:
        alone = head.copy()
        alone[:-1] &= head[1:]
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        some, of = order[at], group[at]
        pair = of * np.int64(count + 2) + rank[some + known]
        by = np.argsort(pair)
        some, pair = some[by], pair[by]
        order[at] = some
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = pair[1:] != pair[:-1]
        head[at] = new
        group[at] = np.maximum.accumulate(np.where(new, at, 0))
        rank[some] = group[at] + 1
        known *= 2
    return order


def common_prefixes(seq: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in ``order``, at most ``limit``.

    Kasai's bound (the suffix one further on shares at least one symbol less)
    fills the values in text order; only places where the preceding symbols of
    the two suffixes differ are compared, all at once, eight symbols at a time.
    ``seq`` ends with 16 zeros or more.
    """
    count = len(order)
    shared = np.zeros(count, np.int64)
    if count < 2:
        return shared
    before = np.full(len(seq), -1, np.int64)
    before[order[1:]] = order[:-1]
    here = np.sort(order[1:])
    other = before[here]
    previous = np.full(len(here), -2, np.int64)
    previous[1:] = np.where(here[1:] == here[:-1] + 1, other[:-1], -2)
    fresh = np.flatnonzero(previous != other - 1)
    length = np.zeros(len(here), np.int64)
    open_ = fresh
    done = np.zeros(len(fresh), np.int64)
    left = np.arange(len(fresh))
    a, b = here[open_], other[open_]
    while len(left):
        same = np.ones(len(left), bool)
        grown = np.zeros(len(left), np.int64)
        for k in range(8):
            x = seq[a + k]
            same &= (x == seq[b + k]) & (x != 0)
            grown += same
        done[left] += grown
        left, a, b = left[same], a[same] + 8, b[same] + 8
    length[fresh] = done
    # A place that is not fresh continues the run of its predecessor: one symbol less.
    run = np.maximum.accumulate(np.where(np.isin(np.arange(len(here)), fresh, assume_unique=True), np.arange(len(here)), 0))
    length = np.maximum(length[run] - (np.arange(len(here)) - run), 0)
    spot = np.zeros(len(seq), np.int64)
    spot[here] = np.minimum(length, limit)
    shared[1:] = spot[order[1:]]
    return shared


def ranges(seq: np.ndarray, order: np.ndarray, queries: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query row (its first ``sizes`` symbols) the range of ``order`` whose suffixes start with it.

    Binary search for all queries at once; ``order`` is sorted at least to the width of the queries.
    """
    width = queries.shape[1]

    def bound(upper: bool) -> np.ndarray:
        low = np.zeros(len(queries), np.int64)
        high = np.full(len(queries), len(order), np.int64)
        while True:
            active = np.flatnonzero(low < high)
            if not len(active):
                return low
            middle = (low[active] + high[active]) // 2
            place = order[middle]
            further = np.zeros(len(active), bool)  # the suffix belongs before the bound
            undecided = np.ones(len(active), bool)
            for k in range(width):
                undecided &= k < sizes[active]
                if not undecided.any():
                    break
                mine, theirs = seq[place + k], queries[active, k]
                further |= undecided & (mine < theirs)
                undecided &= mine == theirs
            if upper:
                whole = np.ones(len(active), bool)
                for k in range(width):
                    whole &= (k >= sizes[active]) | (seq[place + k] == queries[active, k])
                further |= whole
            low[active] = np.where(further, middle + 1, low[active])
            high[active] = np.where(further, high[active], middle)

    return bound(False), bound(True)
