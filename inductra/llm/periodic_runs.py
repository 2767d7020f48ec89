"""Runs of words: stretches that repeat with some period, found in every text.

The words of a text go one by one through a suffix automaton. Its suffix links form a tree on
which every appended word recolours the path from its prefix to the root with its own position:
what was on the path before is made of segments of one colour, the position where all strings of
a segment ended last. A link-cut tree holds the segments, so a word costs O(log n) amortised
steps. Where a segment's previous and new end are no further apart than its longest string, that
string overlaps or touches its own copy: a square. Its distance is the smallest period there, for
a shorter one would have been the last occurrence. Squares are extended to both sides into runs.

A run recurs after one period, so all its words lie in word sequences that the text holds twice.
Stretches without such sequences hold no run and do not enter the automaton.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from inductra.llm.common import GOLDEN, mix, row_slices, tidy, utf8, word_hashes, words

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3

#: Text bytes a task works on at once; a longer text is worked on alone.
SLICE_BYTES = 4 << 20

RUNS = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


class Automaton:
    """Suffix automaton of a sequence of small integers, with its tree of suffix links."""

    def __init__(self, sequence: list[int]):
        # State 1 is the root; 0 stands for none.
        self.length, self.link = [0, 0], [0, 0]
        follow: list[dict[int, int]] = [{}, {}]
        self.prefix: list[int] = []
        length, link, last = self.length, self.link, 1
        for word in sequence:
            state = len(length)
            length.append(length[last] + 1)
            link.append(0)
            follow.append({})
            at = last
            while at and word not in follow[at]:
                follow[at][word] = state
                at = link[at]
            if not at:
                link[state] = 1
            else:
                to = follow[at][word]
                if length[to] == length[at] + 1:
                    link[state] = to
                else:
                    copy = len(length)
                    length.append(length[at] + 1)
                    link.append(link[to])
                    follow.append(dict(follow[to]))
                    while at and follow[at].get(word) == to:
                        follow[at][word] = copy
                        at = link[at]
                    link[to] = link[state] = copy
            last = state
            self.prefix.append(state)


class Paths:
    """Link-cut tree over a rooted tree: preferred paths as splay trees, one colour each.

    The colour stands at the splay root. Depth grows from left to right in a splay tree, so
    after ``_splay`` the left subtree of a node are its ancestors on the path.
    """

    def __init__(self, parents: list[int]):
        self.up = list(parents)
        self.left, self.right = [0] * len(parents), [0] * len(parents)
        self.colour = [-1] * len(parents)

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while True:
            y = up[x]
            if left[y] != x and right[y] != x or not y:
                return
            z = up[y]
            on_left = left[y] == x
            if z and (left[z] == y or right[z] == y):
                # Turn the parent first if both bend the same way, else the node itself.
                if (left[z] == y) == on_left:
                    self._rotate(y)
                else:
                    self._rotate(x)
                self._rotate(x)
            else:
                self.colour[x] = self.colour[y]
                self._rotate(x)
                return
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                # The old splay root is one of the two nodes that were turned past.
                self.colour[x] = self.colour[z]
                return

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[z] == y:
            left[z] = x
        elif right[z] == y:
            right[z] = x
        if left[y] == x:
            inner = left[y] = right[x]
            right[x] = y
        else:
            inner = right[y] = left[x]
            left[x] = y
        if inner:
            up[inner] = y
        up[y] = x
        up[x] = z

    def recolour(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Give the path from ``node`` to the root one colour; its former (deepest node, colour) segments."""
        up, right, colours = self.up, self.right, self.colour
        segments, below, x = [], 0, node
        while x:
            self._splay(x)
            before = colours[x]
            segments.append((x, before))
            cut = right[x]
            if cut:
                colours[cut] = before
            right[x] = below
            below, x = x, up[x]
        colours[below] = colour
        return segments


def squares(sequence: list[int]) -> Iterator[tuple[int, int]]:
    """(last word, period) of squares: every run of two periods or more shows one where it gets that long."""
    automaton = Automaton(sequence)
    # Node 0 of the link-cut tree is "none"; the root itself has no strings.
    paths = Paths(automaton.link)
    length = automaton.length
    for end, state in enumerate(automaton.prefix):
        for node, before in paths.recolour(state, end):
            if before >= 0 and end - before <= length[node]:
                yield end, end - before


def runs_of(sequence: list[int], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start, then period."""
    known: dict[int, int] = {}
    found, n = [], len(sequence)
    for end, period in squares(sequence):
        if known.get(period, -1) >= end:
            continue
        first = end - 2 * period + 1
        while first and sequence[first - 1] == sequence[first - 1 + period]:
            first -= 1
        stop = end + 1
        while stop < n and sequence[stop] == sequence[stop - period]:
            stop += 1
        known[period] = stop - 1
        if stop - first >= max(least, periods * period):
            found.append((first, stop - first, period))
    return sorted(found)


def stretches(hashes: np.ndarray, of: np.ndarray, least: int, periods: int) -> np.ndarray:
    """Words in sequences that their text holds twice; all words of runs are among them.

    The first n - q words of a run of n words and period q recur q words on. They are at least
    ``least - least // periods``, and with their copies they cover the run.
    """
    probe = least - least // periods
    inside = np.zeros(len(hashes), bool)
    if len(hashes) < probe + 1 or periods < 2:
        return inside if periods >= 2 else ~inside
    h = np.zeros(len(hashes) - probe + 1, np.uint64)
    for i in range(probe):
        h = h * GOLDEN + hashes[i : i + len(h)]
    text = of[: len(h)]
    whole = text == of[probe - 1 :]
    at = np.flatnonzero(whole)
    key = mix(h[at] + mix(text[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, at[twice], 1)
    np.add.at(edges, at[twice] + probe, -1)
    return np.cumsum(edges[:-1]) > 0


def text_runs(texts: pa.Array, least: int, periods: int) -> pa.Array:
    """``RUNS`` of every text."""
    raw, offsets = utf8(texts)
    start, end, of = words(raw, offsets)
    n = len(texts)
    inside = stretches(word_hashes(raw, start, end), of, least, periods)
    # Stretches are maximal and never cross two texts.
    fresh = inside.copy()
    fresh[1:] &= ~(inside[:-1] & (of[1:] == of[:-1]))
    firsts = np.flatnonzero(fresh)
    ends_here = inside.copy()
    ends_here[:-1] &= ~(inside[1:] & (of[1:] == of[:-1]))
    stops = np.flatnonzero(ends_here) + 1
    word_of_text = np.searchsorted(of, np.arange(n + 1))
    data = raw.tobytes()
    found: list[list[dict]] = [[] for _ in range(n)]
    drop = np.zeros(len(start) + 1, np.int64)
    for a, b in zip(firsts.tolist(), stops.tolist()):
        if b - a < least:
            continue
        number: dict[bytes, int] = {}
        sequence = [
            number.setdefault(data[s:e], len(number)) for s, e in zip(start[a:b].tolist(), end[a:b].tolist())
        ]
        text = int(of[a])
        base = a - int(word_of_text[text])
        for first, length, period in runs_of(sequence, least, periods):
            found[text].append({"start": base + first, "length": length, "period": period})
            drop[a + first + period] += 1
            drop[a + first + length] -= 1
    kept = np.cumsum(drop[:-1]) == 0
    collapsed = []
    for text in range(n):
        a, b = word_of_text[text], word_of_text[text + 1]
        stay = np.flatnonzero(kept[a:b]) + a
        parts = [data[s:e] for s, e in zip(start[stay].tolist(), end[stay].tolist())]
        collapsed.append(b" ".join(parts).decode("utf-8"))
    return pa.StructArray.from_arrays(
        [
            pa.array(np.diff(word_of_text), pa.int64()),
            pa.array(found, pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))),
            pa.array(collapsed, pa.string()),
        ],
        ["n_words", "runs", "collapsed"],
    )


def find_runs(
    df: DataFrame,
    text: Column | str = "text",
    out: str = "found",
    keep: list[str] | None = None,
    least: int = LEAST_WORDS,
    periods: int = LEAST_PERIODS,
) -> DataFrame:
    """Columns ``keep`` of ``df`` (default: all) and ``out``, a struct (n_words, runs, collapsed).

    Words are sequences of bytes other than blanks and the control characters 9 to 13. A run is
    a stretch of at least ``least`` words and ``periods`` times its smallest period that no
    neighbouring word extends; runs come by start, then period, and may overlap. ``collapsed``
    has the words, joined by one blank, without those that any run contains after that run's
    first period. Null and empty texts have no words and collapse to the empty text. Row by
    row: repeated rows do not matter, and texts of any length are searched whole, the repeating
    part of one text in the memory of one task. Other columns stay, but for one called ``out``.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    column = F.col(text) if isinstance(text, str) else text
    rows = df.select(column.alias("__text"), *[F.col(c) for c in kept])
    schema = StructType([*rows.schema.fields[1:], StructField(out, StructType.fromDDL(f"r {RUNS}")["r"].dataType)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in row_slices(batch.column(0), SLICE_BYTES):
                part = batch.slice(start, end - start)
                found = text_runs(part.column(0), least, periods)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], found], [*kept, out])
            tidy()

    return rows.mapInArrow(run, schema)
