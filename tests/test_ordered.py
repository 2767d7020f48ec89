"""Order-dependent operators: with hot keys split into slices the result must not change."""

import random

import pytest

from inductra.operators import ordered
from inductra.operators.onboarding import sequential_ids


def skewed(spark, seed, rows=400):
    """One key holds half of all rows, many of them at the same time; one key is NULL."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        key = 7 if rng.random() < 0.5 else rng.choice([1, 2, 3, None])
        data.append((i, key, rng.choice([5, 5, 5, rng.randrange(100)]), rng.choice(["x", "y", None])))
    return data, spark.createDataFrame(data, "id bigint, key bigint, at bigint, value string")


@pytest.fixture(params=[True, False])
def broadcasts(request, monkeypatch):
    """Hot keys and slices below and beyond the bounds of a broadcast."""
    if not request.param:
        monkeypatch.setattr(ordered, "BROADCAST_KEYS", 0)
        monkeypatch.setattr(ordered, "BROADCAST_SLICES", 0)


@pytest.mark.parametrize("hot_rows", [1, 20, 60, 10_000])
def test_previous_value(spark, hot_rows, broadcasts):
    data, df = skewed(spark, hot_rows)
    out = ordered.previous_value(df, ["key"], ["at", "id"], ["id", "value"], "before", hot_rows)
    got = {r.id: r.before and tuple(r.before) for r in out.collect()}
    want = {}
    for key in {d[1] for d in data}:
        rows = sorted((d for d in data if d[1] == key), key=lambda d: (d[2], d[0]))
        for before, row in zip([None, *rows], rows):
            want[row[0]] = before and (before[0], before[3])
    assert got == want


@pytest.mark.parametrize("hot_rows", [1, 20, 60, 10_000])
def test_number_within(spark, hot_rows, broadcasts):
    data, df = skewed(spark, hot_rows + 1)
    out = ordered.number_within(df, ["key"], ["at", "id"], "n", "several", hot_rows)
    got = {r.id: (r.n, r.several) for r in out.collect()}
    want = {}
    for key in {d[1] for d in data}:
        rows = sorted((d for d in data if d[1] == key), key=lambda d: (d[2], d[0]))
        want.update({row[0]: (n, len(rows) > 1) for n, row in enumerate(rows, 1)})
    assert got == want


def test_single_rows_are_not_several(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (2, 3)], "key int, id int")
    out = ordered.number_within(df, ["key"], ["id"], "n", "several")
    assert sorted(tuple(r) for r in out.select("id", "n", "several").collect()) == [
        (1, 1, False), (2, 1, True), (3, 2, True),
    ]


def test_hot_key_is_spread_over_slices(spark):
    _, df = skewed(spark, 5)
    _, busy, _ = ordered.split_hot(df, ["key"], ["at", "id"], 60)
    slices = busy.filter("key = 7").groupBy(ordered.SLICE).count().collect()
    assert len(slices) >= 4
    assert max(r["count"] for r in slices) < 0.6 * sum(r["count"] for r in slices)


def test_number_all(spark, broadcasts):
    data, df = skewed(spark, 9)
    out = ordered.number_all(df, ["at", "id"], "n")
    want = {d[0]: n for n, d in enumerate(sorted(data, key=lambda d: (d[2], d[0])), 1)}
    assert {r.id: r.n for r in out.collect()} == want
    assert out.columns == ["id", "key", "at", "value", "n"]


def test_number_all_of_nothing(spark):
    assert ordered.number_all(spark.createDataFrame([], "id bigint"), ["id"], "n").count() == 0


def test_sequential_ids_keep_all_digits(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    out = sequential_ids(df, ["id"], "STF", width=1, start=9)
    assert sorted(r.employee_id for r in out.collect()) == ["STF10", "STF11", "STF9"]
    assert {r.employee_id for r in sequential_ids(df, ["id"], "STF").collect()} == {"STF000001", "STF000002", "STF000003"}


@pytest.mark.parametrize("hot_rows", [1, 30, 10_000])
def test_lowest_running_sum(spark, hot_rows, broadcasts):
    rng = random.Random(hot_rows)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), i // 3, rng.choice([-1, 0, 1])) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, key bigint, at bigint, step int")
    want = {}
    for key in {r[1] for r in rows}:
        total, low = 0, None
        for r in (r for r in rows if r[1] == key):
            total += r[3]
            low = total if low is None else min(low, total)
        want[key] = low
    out = ordered.lowest_running_sum(df.repartition(5), ["key"], ["at", "id"], "step", "low", hot_rows)
    assert {r.key: r.low for r in out.collect()} == want
