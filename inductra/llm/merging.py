"""Merging neighbours in many symbol sequences at once, as byte-pair encodings do.

Sequences lie one after the other in a flat array. In each round every sequence merges its
lowest-rank pair; sequences without one are done and leave the array.
"""

from __future__ import annotations

import numpy as np

from inductra.llm.common import ragged

NEVER = np.int64(1) << np.int64(40)


class Rules:
    """Pairs of symbols with a rank and the symbol they become, as sorted arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = sorted(pairs)
        self.keys = np.array([*(a << 32 | b for a, b in keys), 1 << 62], np.int64)
        self.ranks = np.array([*(pairs[k][0] for k in keys), NEVER], np.int64)
        self.made = np.array([*(pairs[k][1] for k in keys), 0], np.int64)


def merge(rules: Rules, symbols: np.ndarray, sizes: np.ndarray, leftmost: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and sizes of the sequences once nothing can be merged.

    A round merges all non-overlapping occurrences of a sequence's lowest-rank pair, or with
    ``leftmost`` only the first. The first form needs ranks that grow with each merge.
    """
    left = np.zeros(len(sizes), np.int64)
    owner = np.arange(len(sizes))
    finished: list[tuple[np.ndarray, np.ndarray]] = []

    def finish(done: np.ndarray) -> None:
        left[owner[done]] = sizes[done]
        finished.append((owner[done], symbols[np.repeat(done, sizes)]))

    done = sizes < 2
    while True:
        finish(done)
        symbols, sizes, owner = symbols[np.repeat(~done, sizes)], sizes[~done], owner[~done]
        if len(owner) == 0:
            break
        starts = np.cumsum(sizes) - sizes
        pairs = symbols[:-1] << np.int64(32) | symbols[1:]
        at = np.minimum(np.searchsorted(rules.keys, pairs), len(rules.keys) - 1)
        ranks = np.full(len(symbols), NEVER, np.int64)
        ranks[:-1] = np.where(rules.keys[at] == pairs, rules.ranks[at], NEVER)
        ranks[starts + sizes - 1] = NEVER
        lowest = np.minimum.reduceat(ranks, starts)
        done = lowest == NEVER
        place = np.flatnonzero((ranks == np.repeat(lowest, sizes)) & (ranks < NEVER))
        place = first_of_each(place, starts) if leftmost else every_second(place)
        symbols[place] = rules.made[at[place]]
        stay = np.ones(len(symbols), bool)
        stay[place + 1] = False
        sizes = np.add.reduceat(stay.astype(np.int64), starts)
        symbols = symbols[stay]
    order = np.concatenate([o for o, _ in finished])
    flat = np.concatenate([s for _, s in finished])
    begin = np.zeros(len(left), np.int64)
    begin[order] = np.cumsum(left[order]) - left[order]
    return flat[ragged(begin, left)], left


def every_second(place: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring places the 1st, 3rd, 5th, so that no two overlap."""
    if len(place) == 0:
        return place
    fresh = np.ones(len(place), bool)
    fresh[1:] = np.diff(place) > 1
    index = np.arange(len(place))
    run = np.maximum.accumulate(np.where(fresh, index, 0))
    return place[(index - run) % 2 == 0]


def first_of_each(place: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first place in each sequence that has one."""
    if len(place) == 0:
        return place
    sequence = np.searchsorted(starts, place, side="right")
    return place[np.concatenate([[True], sequence[1:] != sequence[:-1]])]
