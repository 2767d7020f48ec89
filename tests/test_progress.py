import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from inductra.operators import progress
from inductra.plans.queries import QUERIES
from inductra.schemas import MODULES, SUBMISSIONS

from rows import by


def at(minute):
    return datetime(2024, 5, 1, 8, minute)


def submissions(spark, rows):
    return spark.createDataFrame(rows, SUBMISSIONS)


def table(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def test_completed_at_stays_when_completion_is_taken_back(spark):
    rows = [
        (1, 3, "ppe", "{}", False, at(1)),
        (2, 3, "ppe", '{"a":1}', True, at(2)),
        (3, 3, "ppe", '{"a":2}', True, at(3)),
        (4, 3, "ppe", '{"a":3}', False, at(4)),
    ]
    row = progress.module_progress(submissions(spark, rows)).first()
    assert (row.answers, row.completed) == ('{"a":3}', False)
    assert (row.completed_at, row.created_at, row.updated_at) == (at(2), at(1), at(4))
    assert row.last_submission_id == 4


def test_never_completed_has_no_completion_time(spark):
    row = progress.module_progress(submissions(spark, [(1, 3, "ppe", "{}", False, at(1))])).first()
    assert row.completed_at is None


def test_equal_times_are_ordered_by_id(spark):
    rows = [(7, 3, "ppe", "late", True, at(1)), (6, 3, "ppe", "early", False, at(1))]
    assert progress.module_progress(submissions(spark, rows)).first().answers == "late"


@pytest.mark.parametrize("seed", range(3))
def test_any_split_and_order_gives_the_same_table(spark, seed):
    rng = random.Random(seed)
    rows = [
        (i, rng.randrange(4), rng.choice(MODULES[:3]), f"a{i}", rng.random() < 0.4, at(rng.randrange(50)))
        for i in range(120)
    ]
    whole = table(progress.module_progress(submissions(spark, rows)))
    rng.shuffle(rows)
    first = progress.module_progress(submissions(spark, rows[:50]))
    both = progress.module_progress(submissions(spark, rows[50:]), first)
    assert table(both) == whole


def test_lacking_values_are_rejected_with_the_first_reason(spark):
    rows = [
        (1, None, "ppe", "{}", True, at(1)), (2, 3, None, None, True, at(1)),
        (3, 3, "ppe", None, True, at(1)), (4, 3, "ppe", "{}", None, at(1)), (5, 3, "ppe", "{}", True, at(1)),
    ]
    accepted, rejected = progress.complete_submissions(submissions(spark, rows))
    assert [r.submission_id for r in accepted.collect()] == [5]
    assert {i: r.reason for i, r in by(rejected, "submission_id").items()} == {
        1: "employee_id:not_null", 2: "module_id:not_null", 3: "answers:not_null", 4: "completed:not_null",
    }


def test_unknown_employees_are_reported(spark, employees):
    rows = [(1, 3, "ppe", "{}", True, at(1)), (2, 99, "ppe", "{}", True, at(1))]
    known, unknown = progress.known_employees_only(progress.module_progress(submissions(spark, rows)), employees)
    assert [r.employee_id for r in known.collect()] == [3]
    assert [(r.employee_id, r.reason) for r in unknown.collect()] == [(99, "employee_id:foreign_key")]


def done(spark, employee, count, total_rows=None):
    return [
        (i, employee, f"m{i}", "{}", i < count, at(1)) for i in range(total_rows or max(count, 1))
    ]


@pytest.mark.parametrize("count,total,expected", [(1, 8, 13), (1, 12, 8), (6, 12, 50), (0, 12, 0), (11, 12, 92), (3, 8, 38)])
def test_percentage_rounds_half_up(spark, employees, count, total, expected):
    saved = progress.module_progress(submissions(spark, done(spark, 4, count)))
    row = by(progress.progress_pct(saved, employees, total), "employee_id")[4]
    assert (row.done, row.progress_pct) == (count, expected)


def test_more_than_all_modules_is_rejected_not_clipped(spark, employees):
    saved = progress.module_progress(submissions(spark, done(spark, 4, 13)))
    fine, refused = progress.in_range(progress.progress_pct(saved, employees))
    assert 4 not in by(fine, "employee_id")
    assert by(refused, "employee_id")[4].progress_pct == 108


@pytest.mark.parametrize(
    "employee,count,rule,expected",
    [
        (3, 11, "sticky", "completed"), (3, 11, "regressing", "in_progress"),
        (3, 0, "sticky", "pending"), (3, 0, "regressing", "pending"),
        (3, 12, "regressing", "completed"), (4, 12, "sticky", "in_progress"),
        (4, 12, "regressing", "in_progress"), (4, 1, "sticky", "in_progress"),
    ],
)
def test_status_rules(spark, employees, employee, count, rule, expected):
    saved = progress.module_progress(submissions(spark, done(spark, employee, count)))
    out = progress.completion_status(progress.progress_pct(saved, employees), rule)
    assert by(out, "employee_id")[employee].completion_status == expected


def test_untouched_employees_keep_percentage_and_status(spark, employees):
    saved = progress.module_progress(submissions(spark, done(spark, 4, 1)))
    out = by(progress.completion_status(progress.progress_pct(saved, employees)), "employee_id")
    assert (out[1].progress_pct, out[1].completion_status) == (100, "completed")
    assert len(out) == 5


def test_flags_equal_the_full_fold_and_skip_the_answers(spark, run_dir):
    rng = random.Random(8)
    rows = [
        (rng.choice([1, -1]) * rng.randrange(2**62, 2**63) + i, rng.randrange(4), rng.choice(MODULES[:4]), "{}",
         rng.random() < 0.5, at(rng.randrange(4)))
        for i in range(300)
    ]
    submissions(spark, rows).write.parquet(run_dir + "/s")
    stored = spark.read.schema(SUBMISSIONS).parquet(run_dir + "/s")
    flags = progress.completion_flags(stored)
    assert table(flags) == table(progress.module_progress(stored).select(*flags.columns))
    plan = flags._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "answers#" not in plan
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_order_holds_in_a_zone_with_clock_changes(spark):
    """02:30 does not exist on this day in New York, and still comes before 03:15."""
    times = [datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10, 3, 15), datetime(2024, 11, 3, 1, 30), datetime(1960, 1, 1)]
    rows = [(i, 3, "ppe", "{}", i == 1, t) for i, t in enumerate(times[:2])]
    rows += [(i, 4, "ppe", "{}", i == 2, t) for i, t in enumerate(times[2:], 2)]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = submissions(spark, rows)
        assert {i: r.completed for i, r in by(progress.completion_flags(df), "employee_id").items()} == {3: True, 4: True}
        assert table(progress.completion_flags(df)) == table(
            progress.module_progress(df).select("employee_id", "module_id", "completed")
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_unused_modules_still_count(spark, employees):
    rows = [(1, 4, "not in the catalogue", "{}", True, at(1))]
    saved = progress.module_progress(submissions(spark, rows))
    assert by(progress.progress_pct(saved, employees), "employee_id")[4].progress_pct == 8
    assert saved.filter(F.col("module_id").isin(*MODULES)).count() == 0


def replayed(spark, employees, rows, rule, stored=(), hot_rows=None):
    saved = progress.module_progress(submissions(spark, list(rows)), progress.module_progress(submissions(spark, list(stored))))
    before = progress.module_progress(submissions(spark, list(stored)))
    low = progress.lowest_done(submissions(spark, list(rows)), employees, before, hot_rows)
    pct = progress.progress_pct(saved, employees)
    return {i: r.completion_status for i, r in by(progress.completion_status(pct, rule, low), "employee_id").items()}


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_a_status_lost_on_the_way_does_not_come_back(spark, employees, hot_rows):
    off_and_on = [(i, e, "ppe", "{}", i % 2 == 0, at(i)) for e in (3,) for i in (1, 2)]
    stored = [(0, 3, "ppe", "{}", True, at(0))]
    assert replayed(spark, employees, off_and_on, "sticky", stored, hot_rows)[3] == "in_progress"
    more = [*stored, (-1, 3, MODULES[5], "{}", True, at(0))]
    assert replayed(spark, employees, off_and_on, "sticky", more, hot_rows)[3] == "completed"
    full = [(-n, 3, m, "{}", True, at(0)) for n, m in enumerate(MODULES)]
    one = [(1, 3, MODULES[2], "{}", False, at(1)), (2, 3, MODULES[2], "{}", True, at(2))]
    assert replayed(spark, employees, one, "regressing", full, hot_rows)[3] == "in_progress"
    assert replayed(spark, employees, one[1:], "regressing", full, hot_rows)[3] == "completed"
    assert replayed(spark, employees, [(1, 3, "ppe", "{}", True, at(1))], "sticky", (), hot_rows)[3] == "completed"


@pytest.mark.parametrize("seed", range(2))
def test_status_equals_one_save_after_another(spark, employees, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 3, 4]), rng.choice(MODULES[:2]), "{}", rng.random() < 0.6, at(i // 2)) for i in range(25)]
    prior = {r.id: r.completion_status for r in employees.collect()}
    done, want = {}, {}
    for _, e, module, _, completed, _ in rows:
        done.setdefault(e, {})[module] = completed
        n = sum(done[e].values())
        now = want.get(e, prior[e])
        want[e] = "pending" if n == 0 else "completed" if now == "completed" else "in_progress"
    got = replayed(spark, employees, rows, "sticky", (), 4 if seed else None)
    assert {e: got[e] for e in want} == want


def test_a_missing_percentage_stays(spark):
    out = spark.createDataFrame([(1, None), (2, 100), (3, 108)], "employee_id bigint, progress_pct int")
    fine, refused = progress.in_range(out)
    assert sorted(r.employee_id for r in fine.collect()) == [1, 2]
    assert [r.employee_id for r in refused.collect()] == [3]


def test_a_submission_without_time_is_refused(spark):
    rows = [(1, 3, "ppe", "{}", True, None), (None, 3, "ppe", "{}", True, at(1)), (2, 3, "ppe", "{}", True, at(2))]
    fine, refused = progress.complete_submissions(submissions(spark, rows))
    assert [r.submission_id for r in fine.collect()] == [2]
    assert sorted(r.reason for r in refused.collect()) == ["submission_id:not_null", "submitted_at:not_null"]


def test_the_whole_save_accounts_for_every_submission(spark, employees):
    rows = [(1, 3, "ppe", "{}", False, at(1)), (2, 99, "ppe", "{}", True, at(2)), (3, 4, "ppe", None, True, at(3)),
            (4, 4, "ppe", "{}", True, at(4)), (5, 1, "extra", "{}", True, at(5))]
    stored = [(-n, 1, m, "{}", True, at(0)) for n, m in enumerate(MODULES)]
    before = progress.module_progress(submissions(spark, stored))
    saved, staff, rejects = progress.save_progress(submissions(spark, rows), before, employees)
    reasons = {r.submission_id: r.reason for r in rejects.collect()}
    assert reasons == {2: "employee_id:foreign_key", 3: "answers:not_null", 5: "progress_pct:range"}
    assert sorted((r.employee_id, r.module_id) for r in saved.collect() if r.employee_id != 1) == [(3, "ppe"), (4, "ppe")]
    assert saved.where("employee_id = 1").count() == len(MODULES)
    after = by(staff, "id")
    assert (after[3].progress_pct, after[3].completion_status) == (0, "pending")
    assert (after[4].progress_pct, after[4].completion_status) == (8, "in_progress")
    assert (after[1].progress_pct, after[1].completion_status) == (100, "completed")
    assert staff.columns == employees.columns


@pytest.mark.parametrize("partitions", [4, 8])
def test_the_whole_save_at_a_size_with_coalesced_shuffles(spark, partitions):
    """Sides of the merge that run with different partition counts must not be zipped as they are."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        saved = QUERIES["save_progress_rows"](spark, "/root/testdata/sf0.1")
        saved.write.format("noop").mode("overwrite").save()
        assert saved.count() == saved.select("employee_id", "module_id").distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_the_merge_is_a_join_and_not_a_union_by_key(spark):
    rows = submissions(spark, [(1, 3, "ppe", "{}", True, at(1)), (2, 3, "ppe", "{}", False, at(2))])
    merged = progress.module_progress(rows, progress.module_progress(rows))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" in plan and "Union" not in plan
    assert merged.count() == 1
