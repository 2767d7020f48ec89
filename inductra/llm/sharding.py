"""Shards of near-equal bytes that never split a group of equal texts.

Groups stand in the order of their text's hash, so neighbours are unrelated and a prefix of
the hash cuts them into even slices for running sums. The shards are contiguous runs of
groups. The smallest capacity that fits is found by binary search, each trial checked by
filling shards greedily; the cuts are then set as evenly as that capacity allows.

The search needs only "the last group end up to x" and "the first from x on". The driver
keeps counts and extremes of ``BLOCKS`` ranges of ends, and has Spark look closer at the few
ranges where the answer is still open. What it holds does not grow with the table.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inductra.llm.common import store
from inductra.operators.ordered import number_within

#: Ranges of group ends the driver knows the extremes of, at first and in each closer look.
BLOCKS = 1 << 15

#: Bytes counted for a row besides its text.
ROW_BYTES = 8

#: Leading hex digits of the hash that cut groups into slices for the running sums.
SLICE_DIGITS = 3


class Ends:
    """Sorted running totals at group ends, known as ranges with (lowest, highest, count)."""

    def __init__(self, ends: DataFrame, total: int):
        self.ends, self.total = ends, total
        self.low: list[int] = []
        self.high: list[int] = []
        self.count: list[int] = []
        self._look([(1, total, total)])

    def _look(self, ranges: list[tuple[int, int, int]]) -> None:
        """Replace what is known inside (first, last, widest block) ranges by a closer look.

        New blocks are at most half as wide as the widest they replace, so every look gets closer.
        """
        length = sum(b - a + 1 for a, b, _ in ranges)
        even = max(1, -(-length // BLOCKS))
        inside, block = F.lit(False), F.lit(None).cast("bigint")
        for i, (a, b, widest) in enumerate(ranges):
            here = F.col("end").between(a, b)
            inside = inside | here
            width = max(1, min(even, widest // 2))
            number = F.floor((F.col("end") - a) / F.lit(width)).cast("bigint") * len(ranges) + i
            block = F.when(here, number).otherwise(block)
        found = (
            self.ends.where(inside)
            .groupBy(block.alias("block"))
            .agg(F.min("end").alias("low"), F.max("end").alias("high"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        rows = [(r["low"], r["high"], r["n"]) for r in found]
        starts = [a for a, _, _ in ranges]

        def outside(value: int) -> bool:
            i = bisect_right(starts, value) - 1
            return i < 0 or value > ranges[i][1]

        rows += [k for k in zip(self.low, self.high, self.count) if outside(k[0])]
        rows.sort()
        self.low, self.high, self.count = ([r[i] for r in rows] for i in range(3))

    def last_upto(self, x: int) -> tuple[int, int]:
        """Bounds of the largest end up to ``x``; 0 if there is none."""
        i = bisect_right(self.low, x) - 1
        if i < 0:
            return 0, 0
        if x >= self.high[i]:
            return self.high[i], self.high[i]
        if self.count[i] == 2:
            return self.low[i], self.low[i]
        return self.low[i], min(x, self.high[i])

    def first_from(self, x: int) -> tuple[int, int]:
        """Bounds of the smallest end that is ``x`` or more."""
        i = bisect_left(self.high, x)
        if x <= self.low[i]:
            return self.low[i], self.low[i]
        if self.count[i] == 2:
            return self.high[i], self.high[i]
        return max(x, self.low[i]), self.high[i]

    def closer(self, spans: list[tuple[int, int]]) -> None:
        """Look closer at all ranges that touch the spans."""
        ranges: list[tuple[int, int, int]] = []
        for a, b in sorted(spans):
            first = max(0, bisect_right(self.low, a) - 1)
            last = max(first, bisect_right(self.low, b) - 1)
            a, b = self.low[first], max(self.high[first : last + 1])
            widest = max(h - l + 1 for l, h in zip(self.low[first : last + 1], self.high[first : last + 1]))
            if ranges and a <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(ranges[-1][1], b), max(ranges[-1][2], widest))
            else:
                ranges.append((a, b, widest))
        self._look(ranges)


def fill(ends: Ends, capacity: int, shards: int, bound: int) -> list[int]:
    """Where shards filled greedily to ``capacity`` end; by lower (0) or upper (1) bounds."""
    at, path = 0, []
    for _ in range(shards):
        at = max(at, ends.last_upto(at + capacity)[bound])
        path.append(at)
    return path


def smallest(ends: Ends, shards: int, bound: int) -> int:
    """Smallest capacity for which the greedy check reaches the end."""
    low, high = max(1, -(-ends.total // shards)), ends.total
    while low < high:
        middle = (low + high) // 2
        if fill(ends, middle, shards, bound)[-1] >= ends.total:
            high = middle
        else:
            low = middle + 1
    return low


def minimax_capacity(ends: Ends, shards: int) -> int:
    """The smallest capacity with which ``shards`` contiguous runs of groups hold everything."""
    while True:
        least, enough = smallest(ends, shards, 1), smallest(ends, shards, 0)
        if least == enough:
            return least
        ends.closer(list(zip(fill(ends, least, shards, 0), fill(ends, enough, shards, 1))))


def cut(ends: Ends, capacity: int, shards: int) -> list[int]:
    """Running totals at which the shards end, each up to ``capacity`` and as even as can be.

    A shard ends near its share of what is left, but no earlier than the rest allows: going
    back from the end, ``floor[k]`` is the first end after which the other shards suffice. It
    takes one group at least, and ``ceiling[k]`` leaves one for each shard behind it, so a
    shard is empty only if there are fewer groups than shards.
    """
    while True:
        open_spans: list[tuple[int, int]] = []

        def known(bounds: tuple[int, int], pick: int) -> int:
            if bounds[0] != bounds[1]:
                open_spans.append(bounds)
            return bounds[pick]

        floor = [ends.total]
        for _ in range(shards - 1):
            rest = floor[-1] - capacity
            floor.append(known(ends.first_from(rest), 1) if rest > 0 else 0)
        floor.reverse()
        ceiling = [ends.total]
        for _ in range(shards - 1):
            ceiling.append(known(ends.last_upto(ceiling[-1] - 1), 0) if ceiling[-1] > 0 else 0)
        ceiling.reverse()
        at, cuts = 0, []
        for k in range(shards - 1):
            limit = known(ends.last_upto(at + capacity), 0)
            wanted = at + (ends.total - at) // (shards - k)
            near = known(ends.last_upto(wanted), 0)
            after = known(ends.first_from(min(wanted + 1, ends.total)), 1)
            if after - wanted < wanted - near:
                near = after
            one_group = known(ends.first_from(min(at + 1, ends.total)), 1)
            at = max(one_group, floor[k], min(near, limit, ceiling[k]))
            cuts.append(at)
        if not open_spans:
            return [*cuts, ends.total]
        ends.closer(open_spans)


def shard_by_bytes(df: DataFrame, shards: int, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Rows with ``shard`` and ``slot``; shard sizes in bytes are near equal.

    Returns (row id, size, text_crc32, shard, slot). ``size`` is the UTF-8 length of the text
    plus ``ROW_BYTES``. Rows of equal text share a shard; missing texts are one group of their
    own, apart from empty ones. Slots run from 0 without gaps; equal texts are ordered by
    row id, a missing id first, and repeated rows in any order. The largest shard is as small
    as groups that stay whole in this order allow. An empty table gives no rows.
    """
    rows = df.select(
        F.col(row_id).alias("row_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit("")).alias("group"),
    )
    rows = store(rows, "shard-rows")
    groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    groups = groups.withColumn("slice", F.substring("group", 1, SLICE_DIGITS))
    sums = groups.groupBy("slice").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    # One row per slice, at most 16 ** SLICE_DIGITS + 1.
    earlier = Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "slice",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
    )
    running = Window.partitionBy("slice").orderBy("group")
    placed = groups.withColumns(
        {"upto": F.sum("bytes").over(running), "first": F.sum("n").over(running) - F.col("n")}
    ).join(F.broadcast(offsets), "slice")
    placed = placed.select(
        "group",
        (F.col("first") + F.col("n_before")).alias("first"),
        (F.col("upto") + F.col("bytes_before")).alias("end"),
    )
    placed = store(placed, "shard-groups")
    total = placed.agg(F.max("end")).first()[0] or 0
    if total:
        ends = Ends(placed.select("end"), total)
        cuts = cut(ends, minimax_capacity(ends, shards), shards)
    else:
        cuts = []
    number = F.lit(0)
    for c in cuts[:-1]:
        number = number + F.when(F.col("end") > c, 1).otherwise(0)
    placed = placed.withColumn("shard", number.cast("int"))
    # One row per shard.
    firsts = placed.groupBy("shard").agg(F.min("first").alias("shard_first"))
    placed = placed.join(F.broadcast(firsts), "shard").select(
        F.col("group").alias("of"), "shard", (F.col("first") - F.col("shard_first")).alias("before")
    )
    numbered = number_within(rows, ["group"], ["row_id"], "place")
    joined = numbered.join(placed, F.col("group") == F.col("of"))
    return joined.select(
        F.col("row_id").alias(row_id),
        "size",
        "text_crc32",
        "shard",
        (F.col("before") + F.col("place") - 1).cast("bigint").alias("slot"),
    )
