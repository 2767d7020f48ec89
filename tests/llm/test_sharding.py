"""Shards against an exhaustive search over the same order of groups."""

import random
from collections import defaultdict
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate
from zlib import crc32

import pandas as pd
import pytest

from inductra.llm import sharding
from inductra.llm.queries import op1_sharding


def group(text):
    return "" if text is None else sha256(text.encode()).hexdigest()


def best(sizes, shards):
    """The smallest possible largest shard, trying every cut."""

    @lru_cache(None)
    def least(start, left):
        if left == 1:
            return sum(sizes[start:])
        out, total = 1 << 60, 0
        for end in range(start, len(sizes) + 1):
            out = min(out, max(total, least(end, left - 1)))
            if end < len(sizes):
                total += sizes[end]
        return out

    return least(0, shards)


def check(rows, out, shards):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted(
        (str(i), len((t or "").encode()) + 8, crc32((t or "").encode())) for i, t in rows
    )
    sizes, slots, by_group = defaultdict(int), defaultdict(list), defaultdict(int)
    for i, t in rows:
        by_group[group(t)] += len((t or "").encode()) + 8
    for r in out:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(shards))
    ordered = [by_group[g] for g in sorted(by_group)]
    assert max(sizes.values(), default=0) == (best(tuple(ordered), shards) if ordered else 0)
    return sizes


@pytest.mark.parametrize("blocks", [1 << 15, 3, 2])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_smallest_capacity(texts, clashing, monkeypatch, blocks, seed):
    monkeypatch.setattr(sharding, "BLOCKS", blocks)
    rng = random.Random(seed)
    base = ["x" * rng.randint(0, 200) + str(k) for k in range(30)] + ["é" * 700]
    rows = [(i, rng.choice(base)) for i in range(70)] + [(70, None), (71, None), (72, ""), (3, base[0]), (None, base[1])]
    out = sharding.shard_by_bytes(clashing(texts(rows)), 5).collect()
    sizes = check(rows, out, 5)
    assert len(sizes) == 5
    where = defaultdict(set)
    texts_of = {}
    for r in out:
        where[(r.size, r.text_crc32)].add(r.shard)
        texts_of[r.doc_id] = r
    assert all(len(s) == 1 for (size, _), s in where.items() if size > 8)


def test_few_rows(texts):
    for rows in ([], [(1, None)], [(1, "a"), (2, "b")], [(i, "x" * i * i) for i in range(4)]):
        sizes = check(rows, sharding.shard_by_bytes(texts(rows), 4).collect(), 4)
        assert len(sizes) == len(rows)


class ListEnds(sharding.Ends):
    """The same search over a plain list instead of a table."""

    def _look(self, ranges):
        known = [k for k in zip(self.low, self.high, self.count) if not any(a <= k[0] <= b for a, b, _ in ranges)]
        even = max(1, -(-sum(b - a + 1 for a, b, _ in ranges) // sharding.BLOCKS))
        for a, b, widest in ranges:
            width = max(1, min(even, widest // 2))
            found = pd.Series([e for e in self.ends if a <= e <= b])
            known += [(int(g.min()), int(g.max()), len(g)) for _, g in found.groupby((found - a) // width)]
        known.sort()
        self.low, self.high, self.count = ([r[i] for r in known] for i in range(3))


@pytest.mark.parametrize("seed", range(40))
def test_search_ends_with_more_shards_than_ranges(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(sharding, "BLOCKS", rng.choice([2, 3, 8]))
    sizes = [rng.choice([8, rng.randint(9, 60), rng.randint(9, 4000)]) for _ in range(rng.randint(24, 90))]
    ends = list(accumulate(sizes))
    known, shards = ListEnds(ends, ends[-1]), rng.choice([3, 24])
    capacity = sharding.minimax_capacity(known, shards)
    assert capacity == best(tuple(sizes), shards)
    cuts = sharding.cut(known, capacity, shards)
    assert len(cuts) == len(set(cuts)) == shards and set(cuts) <= set(ends)
    assert max(b - a for a, b in zip([0, *cuts], cuts)) == capacity


def test_near_equal_without_large_groups(texts):
    rows = [(i, f"{i:05}" * 20) for i in range(400)]
    sizes = check_sizes(sharding.shard_by_bytes(texts(rows), 8).collect())
    assert max(sizes) - min(sizes) <= 2 * 108


def test_a_hot_group_leaves_the_others_even(texts):
    rows = [(i, "hot" * 40) for i in range(150)] + [(200 + i, f"{i:05}" * 20) for i in range(300)]
    sizes = sorted(check_sizes(sharding.shard_by_bytes(texts(rows), 8).collect()))
    assert len(sizes) == 8
    assert sizes[0] > 0.5 * sizes[-2]


def check_sizes(out):
    sizes = defaultdict(int)
    for r in out:
        sizes[r.shard] += r.size
    return list(sizes.values())


def test_query(spark, documents, sf_dir):
    out = op1_sharding(spark, sf_dir).collect()
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert len(out) == len(rows)
    sizes = check_sizes(out)
    assert len(sizes) == 24
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}
