"""Suffix orders of many short texts by linear grouping, all texts in step.

A suffix's group is fixed by its Lyndon prefix. Phase one takes the groups of a text from the
highest down; the members of a group point, by previous-smaller pointers, at suffixes whose
Lyndon prefix they extend, and these move to new groups right behind their old ones. Phase
two takes the groups from the lowest up and orders each by the rank of the suffix that
follows the Lyndon prefix (and its repeats), which lies in a lower group and is final. Nothing is renamed and
there is no recursion. A step handles one group of every text at once.
"""

from __future__ import annotations

import numpy as np

from inductra.llm.common import ragged


def suffix_order(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all suffixes, text after text, each text's in ascending order.

    ``symbols`` holds the texts one after the other; a text's end is smaller than any symbol.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    lengths = lengths[lengths > 0]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    text = np.repeat(np.arange(len(lengths)), lengths)
    order, group, size, prefix = _group(symbols, text, starts, ends)
    return _emit(order, group, size, prefix, text, starts, ends)


def _group(symbols, text, starts, ends):
    """Suffixes in group order, and by suffix the first slot of its group and its Lyndon prefix's length.

    ``size`` is the number of members by the first slot of a group.
    """
    n = len(symbols)
    none = n  # the place before a text
    order = np.lexsort((symbols, text))
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    ranked_text, ranked_symbol = text[order], symbols[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (ranked_text[1:] != ranked_text[:-1]) | (ranked_symbol[1:] != ranked_symbol[:-1])
    first = np.flatnonzero(fresh)
    size = np.zeros(n, np.int64)
    size[first] = np.diff(np.append(first, n))
    group = np.empty(n + 1, np.int64)
    group[order] = np.repeat(first, size[first])
    group[none] = -1
    previous = np.arange(-1, n, dtype=np.int64)
    previous[starts] = none
    prefix = np.ones(n, np.int64)
    moving = np.zeros(n, bool)
    stop, low = ends.copy(), starts
    while len(stop):
        top = order[stop - 1]
        begin = group[top]
        count = stop - begin
        members = order[ragged(begin, count)]
        bound = np.repeat(begin, count)
        # Nearest place before with a lower group.
        to = previous[members]
        open_ = np.flatnonzero(group[to] >= bound)
        while len(open_):
            to[open_] = previous[to[open_]]
            previous[members[open_]] = to[open_]
            open_ = open_[group[to[open_]] >= bound[open_]]
        previous[members] = to
        # Extend what the members point at.
        added = np.repeat(prefix[top], count)
        real = to != none
        to, added = to[real], added[real]
        if len(to):
            ranked = np.argsort(to, kind="stable")
            to, added = to[ranked], added[ranked]
            head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            times = np.diff(np.append(head, len(to)))
            to = to[head]
            prefix[to] += times * added[head]
            ranked = np.lexsort((times, group[to]))
            to, times = to[ranked], times[ranked]
            old = group[to]
            new_old = np.concatenate([[True], old[1:] != old[:-1]])
            head = np.flatnonzero(new_old)
            movers = np.diff(np.append(head, len(to)))
            tail = old[head] + size[old[head]] - movers
            target = ragged(tail, movers)
            moving[to] = True
            there = order[target]
            staying = there[~moving[there]]
            left = slot[to]
            left = left[left < np.repeat(tail, movers)]
            moving[to] = False
            order[left] = staying
            slot[staying] = left
            order[target] = to
            slot[to] = target
            subgroup = np.flatnonzero(new_old | np.concatenate([[True], times[1:] != times[:-1]]))
            members_of = np.diff(np.append(subgroup, len(to)))
            size[old[head]] -= movers
            group[to] = np.repeat(target[subgroup], members_of)
            size[target[subgroup]] = members_of
        going = begin > low
        stop, low = begin[going], low[going]
    return order, group[:n], size, prefix


def _emit(order, group, size, prefix, text, starts, ends):
    """Order the members of each group, lowest groups first."""
    n = len(order)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.arange(n)
    rank[n] = -1
    follower = np.arange(n) + prefix
    follower[follower == ends[text]] = n
    # A Lyndon prefix may repeat: then the follower is in the same group. Count how often, and
    # take what follows the last one; fewer repeats come first.
    within = np.append(group, -1)
    repeats = np.append((within[follower] == group).astype(np.int64), 0)
    hop = np.append(np.where(repeats[:-1] > 0, follower, np.arange(n)), n)
    while True:
        more = repeats[hop]
        if not more.any():
            break
        repeats += more
        hop = hop[hop]
    follower = follower[hop[:n]]
    first = group[order]
    many = np.flatnonzero((first == np.arange(n)) & (size > 1))
    if len(many) == 0:
        return order
    of = text[order[many]]
    turn = np.arange(len(many)) - np.searchsorted(of, of)
    by_turn = np.argsort(turn, kind="stable")
    many, turn = many[by_turn], turn[by_turn]
    cuts = np.flatnonzero(np.diff(turn)) + 1
    for now in np.split(many, cuts):
        slots = ragged(now, size[now])
        members = order[slots]
        key = (rank[follower[members]], repeats[members], np.repeat(now, size[now]))
        members = members[np.lexsort(key)]
        order[slots] = members
        rank[members] = slots
    return order
