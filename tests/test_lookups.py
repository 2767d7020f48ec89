"""Codes by rank, batches against stored tables, versions of two writers, uuids, first attempts of a busy request."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inductra.operators import checks, onboarding, people, progress, rules
from inductra.operators.ordered import uuid_order
from inductra.schemas import CODE_PREFIX, FIRST_CODE, LAST_CODE
from inductra.sources import tables as sources

from rows import by

SIZE = LAST_CODE - FIRST_CODE + 1


def walked(used, n, seed):
    """The first n free codes, step by step."""
    out, step = [], 0
    while len(out) < n and step < SIZE:
        code = f"{CODE_PREFIX}{FIRST_CODE + (step * onboarding.CODE_STRIDE + seed) % SIZE}"
        if code not in used:
            out.append(code)
        step += 1
    return out


@pytest.mark.parametrize("seed,n_used,wanted", [(0, 0, 5), (7, 400_000, 900), (123_456, 899_990, 50), (1, 1000, 0)])
def test_free_codes_in_the_order_of_the_walk(spark, seed, n_used, wanted):
    used = random.Random(seed).sample(range(FIRST_CODE, LAST_CODE + 1), n_used)
    odd = ["EMP0100000", "emp100001", "EMP99999", "EMP1000000", "", None, "EMP12x456", "XYZ100002"]
    codes = spark.createDataFrame([(f"EMP{c}",) for c in used[:20]] + [(c,) for c in odd], "employee_code string")
    many = spark.createDataFrame([(c,) for c in used], "c bigint").selectExpr("concat('EMP', c) AS employee_code")
    free = onboarding.free_codes(codes.unionByName(many), wanted, seed)
    rows = {r._place: r.employee_code for r in free.collect()}
    want = walked({f"EMP{c}" for c in used}, wanted, seed)
    assert [rows.get(i + 1) for i in range(len(want))] == want
    assert wanted == 0 or len(rows) <= wanted + 63


def test_only_new_violations_of_a_batch(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, "e")], "id bigint, k string")
    batch = spark.createDataFrame([(6, "a"), (7, "c"), (8, "c"), (9, None), (10, "d")], "id bigint, k string")
    found = rules.unique_in_batch(batch, stored, "k").collect()
    assert sorted(tuple(r) for r in found) == [("k:unique", "a", 2), ("k:unique", "c", 2)]
    missing = rules.foreign_key_in_batch(batch, "k", stored, "k").collect()
    assert sorted(tuple(r) for r in missing) == [("k:foreign_key", "c", 2), ("k:foreign_key", "d", 1)]


@pytest.mark.parametrize("limit", [0, 100])
def test_a_large_stored_table_is_not_shuffled_for_a_small_batch(spark, monkeypatch, limit):
    monkeypatch.setattr(rules, "BROADCAST_BATCH_KEYS", limit)
    stored = spark.range(100_000).selectExpr("id AS k").hint("merge")
    batch = spark.createDataFrame([(5,), (100_001,)], "k bigint")
    out = rules.unique_in_batch(batch, stored, "k")
    assert [tuple(r) for r in out.collect()] == [("k:unique", "5", 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    if limit:
        assert "LeftSemi, BuildRight" in plan


def test_two_writers_both_keep_their_version(spark, run_dir, monkeypatch):
    root, clock = run_dir + "/table", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    assert sources.write_snapshot(spark.range(1), root, "first", clock) == 1
    claim, raced = sources._claim, []

    def race(spark_, path, content):
        # The other writer publishes between this one's look and its claim.
        if not raced:
            raced.append(True)
            assert sources.write_snapshot(spark.range(2), root, "other", clock) == 2
        return claim(spark_, path, content)

    monkeypatch.setattr(sources, "_claim", race)
    assert sources.write_snapshot(spark.range(3), root, "mine", clock) == 3
    assert [sources.read_snapshot(spark, root, v).count() for v in (1, 2, 3)] == [1, 2, 3]
    assert sources.read_snapshot(spark, root).count() == 3
    raced.clear()
    with pytest.raises(sources.VersionConflict):
        monkeypatch.setattr(sources, "_claim", claim)
        sources.write_snapshot(spark.range(4), root, "stale", clock, expected=2)
    assert sources.write_snapshot(spark.range(4), root, "fresh", clock, expected=3) == 4
    assert sources.read_snapshot(spark, root).count() == 4


def test_uuids_order_as_their_text(spark):
    rng = random.Random(1)
    start = datetime(1969, 12, 31, 23, 59)
    head = "ffffffff-ffff-4fff-8"
    ids = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(60)]
    ids += [head + "".join(rng.choice("0f") for _ in range(3)) + "-" + "".join(rng.choice("0f") for _ in range(12)) for _ in range(60)]
    rows = [(start + timedelta(microseconds=rng.randrange(3) * 60_000_000), i) for i in ids]
    df = spark.createDataFrame(rows, "at timestamp_ntz, id string")
    first, second = uuid_order(df, "at", "id")
    got = [(r.at, r.id) for r in df.withColumns({"a": first, "b": second}).orderBy("a", "b").collect()]
    assert got == sorted(rows)
    none = spark.createDataFrame([(start, "x"), (start, None)], "at timestamp_ntz, id string")
    assert none.select(uuid_order(none, "at", "id")[0].alias("a")).where("a IS NOT NULL").count() == 0


def test_status_of_uuid_submissions(spark):
    """Same time and same head: the last hex digits decide, in a hash aggregate."""
    at = datetime(2024, 5, 1)
    uid = "00000000-0000-4000-8000-0000000000{:02x}".format
    rows = [(uid(n), e, "ppe", "{}", done, at) for e, flags in ((1, "TF"), (2, "FT"), (3, "TFT")) for n, done in enumerate(f == "T" for f in flags)]
    schema = "submission_id string, employee_id bigint, module_id string, answers string, completed boolean, submitted_at timestamp_ntz"
    flags = progress.completion_flags(spark.createDataFrame(rows, schema).repartition(3))
    assert {r.employee_id: r.completed for r in flags.collect()} == {1: False, 2: True, 3: True}
    plan = flags._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_a_busy_request_sends_few_rows(spark):
    columns = "request_id bigint, attempt_rank int, model string, ok boolean, status int, error_message string, reply_text string"
    rows = [(1, n, f"m{n}", False, 500, "down", None) for n in range(500)]
    rows += [(2, n, f"m{n}", n == 70, 200, None, "fine" if n == 70 else "") for n in range(100)]
    out = checks.first_success(spark.createDataFrame(rows, columns).repartition(4), "question")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 50, Partial" in plan
    got = by(out, "request_id")
    assert got[2].model == "m70" and got[2].succeeded and got[2].n_attempts == 100
    assert got[1].error.endswith(" | and 450 more") and got[1].error.count("500 down") == 50


def test_the_log_is_not_shuffled_for_few_deletions(spark, employees, monkeypatch):
    deletions = spark.sql("SELECT 1L AS deletion_id, 3L AS emp_id, 101L AS actor_auth_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS deleted_at")
    log = spark.range(1000).selectExpr("id", "id % 5 AS actor_id", "id % 7 AS target_id")
    for limit in (10, 0):
        monkeypatch.setattr(people, "BROADCAST_IDS", limit)
        out = people.Deletion(deletions, employees).without_references(log)
        got = {r.id: (r.actor_id, r.target_id) for r in out.collect()}
        assert got == {i: (None if i % 5 == 3 else i % 5, None if i % 7 == 3 else i % 7) for i in range(1000)}
        if limit:
            assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
