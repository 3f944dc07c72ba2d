"""Suffix arrays by linear grouping, for many small texts in lock step.

The construction has two phases and renames nothing. The first puts suffixes
into groups of equal longest Lyndon prefix: groups start as first characters and
are processed in descending order; each suffix of a group points to the previous
suffix of a smaller group, and suffixes that are pointed to leave their groups
for new ones just above, the more pointers the higher. The second phase walks
the suffixes in ascending order: what precedes a suffix, and everything on its
chain of pointers to previous smaller ones, is the next of its group.

All texts take each step together, so that a step's work is array operations
over as many groups as there are texts; a text that is done takes part no more.
"""

from __future__ import annotations

import numpy as np

from sparkloom.llm.common import travels

travels(__name__)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .., in one array."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def lyndon_groups(chars: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, previous) of every position; text t is chars[base[t] : base[t] + size[t]] and
    ends with a sentinel that is smaller than all else in it and stands there only.

    A group is named by the place of its first suffix among all sorted ones; a
    position without a previous smaller one gets base - 1 of its text.
    """
    n = len(chars)
    text = np.repeat(np.arange(len(base)), size)
    order = np.lexsort((chars, text))
    c, t = chars[order], text[order]
    first = np.ones(n, bool)
    first[1:] = (c[1:] != c[:-1]) | (t[1:] != t[:-1])
    starts = np.flatnonzero(first)
    group = np.empty(n + 1, np.int64)
    group[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    group[n] = -1  # position -1, before the first text
    count = np.zeros(n, np.int64)
    count[starts] = np.diff(np.append(starts, n))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    previous = np.arange(-1, n - 1)
    moves, aimed = np.zeros(n, bool), np.zeros(n, bool)
    top = base + size
    live = np.flatnonzero(size > 0)
    while len(live):
        s = group[order[top[live] - 1]]
        width = top[live] - s
        members = order[_spread(s, width)]
        own = np.repeat(s, width)
        low = np.repeat(base[live], width)
        p = members - 1
        while True:  # over what is already processed
            up = (p >= low) & (group[p] > own)
            if not up.any():
                break
            p[up] = previous[p[up]]
        previous[members] = p
        while True:  # over suffixes of the same group
            same = (p >= low) & (group[p] == own)
            if not same.any():
                break
            p = np.where(same, previous[p], p)
            previous[members] = p
        p = np.where(p >= low, p, low - 1)
        previous[members] = p
        top[live] = s
        pointed, times = np.unique(p[p >= low], return_counts=True)
        if len(pointed):
            g = group[pointed]
            by = np.lexsort((pointed, times, g))
            pointed, times, g = pointed[by], times[by], g[by]
            run = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            each = np.diff(np.append(run, len(g)))
            head = g[run]
            total = count[head]
            target = _spread(head + total - each, each)
            now = place[pointed]
            taken = order[target]
            moves[pointed], aimed[target] = True, True
            displaced, vacated = taken[~moves[taken]], now[~aimed[now]]  # as many of either in each group
            moves[pointed], aimed[target] = False, False
            order[vacated], place[displaced] = displaced, vacated
            order[target], place[pointed] = pointed, target
            fresh = np.append(True, (g[1:] != g[:-1]) | (times[1:] != times[:-1]))
            at = np.flatnonzero(fresh)
            many = np.diff(np.append(at, len(g)))
            count[head] = total - each
            count[target[at]] = many
            group[pointed] = np.repeat(target[at], many)
        live = live[top[live] > base[live]]
    return group[:n], previous


def suffix_arrays(chars: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffixes of all texts, each text's in ascending order at its own places."""
    group, previous = lyndon_groups(chars, base, size)
    n = len(chars)
    out = np.full(n, -1, np.int64)
    free = np.arange(n)  # the next free place of the group that starts here
    placed = np.zeros(n, bool)
    some = np.flatnonzero(size > 0)
    last = base[some] + size[some] - 1
    out[base[some]] = last
    placed[last] = True
    free[base[some]] += 1
    low, end = base[some], base[some] + size[some]
    rank, j = base[some].copy(), last - 1
    while len(rank):
        chain = (j >= low) & ~placed[np.maximum(j, 0)]
        k = j[chain]
        at = free[group[k]]
        out[at] = k
        placed[k] = True
        free[group[k]] = at + 1
        j = np.where(chain, previous[np.maximum(j, 0)], j)
        step = ~chain
        rank = rank + step
        more = rank < end
        if not more.all():
            rank, j, low, end, step = rank[more], j[more], low[more], end[more], step[more]
        j = np.where(step, out[rank] - 1, j)
    return out
