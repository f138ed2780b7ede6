"""Suffix arrays by linear grouping.

First suffixes are grouped by their longest Lyndon prefix. All start in the groups of their first symbols. Groups are
taken from the highest to the lowest. Members of the group at hand are final; the nearest earlier position in a lower
group, its previous-smaller pointer, starts a Lyndon prefix that goes on with the group's. Such positions leave their
groups for new ones right above, the more copies of the group's prefix follow, the higher. Then the array is filled from
its lowest end: once a suffix has its place, the suffixes before it along the pointers get the next places of their
groups. Nothing is sorted by comparison of suffixes and nothing is renamed.
"""

from __future__ import annotations

import numpy as np


def grouped(text: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(group of each suffix, named by where it begins; previous-smaller pointers; suffixes in the order of groups)."""
    n = len(text)
    by_symbol = np.argsort(text, kind="stable")
    order = by_symbol.tolist()
    place = np.empty(n, np.int64)
    place[by_symbol] = np.arange(n)
    place = place.tolist()
    _, first, inverse, sizes = np.unique(text, return_index=True, return_inverse=True, return_counts=True)
    begins = np.cumsum(sizes) - sizes
    group = begins[inverse].tolist()
    size, last = [0] * (n + 1), [-1] * n  # of a group at its begin; the begin of the group that ends before a place
    for b, k in zip(begins.tolist(), sizes.tolist(), strict=True):
        size[b] = k
        last[b + k - 1] = b
    before = [-1] * n
    end = n
    while end > 0:
        begin = last[end - 1]
        if end - begin == 1:  # a single member moves at most one position, alone
            i = order[begin]
            j = i - 1
            while j >= 0 and group[j] >= begin:
                j = before[j]
            before[i] = j
            end = begin
            if j >= 0:
                g = group[j]
                k = size[g] - 1
                if k:
                    size[g] = k
                    new, at = g + k, place[j]
                    if new != at:
                        other = order[new]
                        order[at], order[new] = other, j
                        place[other], place[j] = at, new
                    size[new] = 1
                    last[new - 1], last[new] = g, new
                    group[j] = new
            continue
        members = order[begin:end]
        members.sort()
        counts: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= begin:
                j = before[j]
            before[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        end = begin
        if not counts:
            continue
        if len(counts) == 1:
            levels = [list(counts)]
        else:
            most = max(counts.values())
            if most == 1:
                levels = [list(counts)]
            else:
                levels = [[] for _ in range(most)]
                for j, k in counts.items():
                    levels[most - k].append(j)
        for moved in levels:
            left: dict[int, int] = {}
            for j in moved:  # to the upper end of its group
                g = group[j]
                k = size[g] - 1
                size[g] = k
                left[g] = left.get(g, 0) + 1
                to, at = g + k, place[j]
                if to != at:
                    other = order[to]
                    order[at], order[to] = other, j
                    place[other], place[j] = at, to
            for g, k in left.items():
                rest = size[g]
                new = g + rest
                size[new] = k
                if rest:
                    last[new - 1] = g
                    last[new + k - 1] = new
                    for at in range(new, new + k):
                        group[order[at]] = new
    return group, before, order


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of the suffixes of text. Its least symbol ends strings: suffixes are ordered up to it, and further by
    where they stand. The last symbol must be the least one. Linear in the length apart from sorting positions in groups.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    group, before, _ = grouped(text)
    out = [0] * n
    free = list(range(n))  # the next place of a group, at its begin
    done = bytearray(n)
    ends = np.flatnonzero(text == text.min()).tolist()
    for at, i in enumerate(ends):
        out[at] = i
        done[i] = 1
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = before[j]
    return np.array(out, np.int64)
