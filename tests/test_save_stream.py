"""The save as a stream against the save as one batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inductra.operators import progress
from inductra.plans.queries import QUERIES
from inductra.schemas import MODULES, SUBMISSIONS
from inductra.streaming import saving, streams
from inductra.streaming.folders import ChangeFolders

from rows import by

START = datetime(2024, 5, 1)


def some_submissions(rng, n, staff=(3, 4, 5, 99)):
    """Few employees, few modules and repeated times, so that states change often."""
    rows = [
        (i, rng.choice(staff), rng.choice(MODULES[:3]), f"a{i}", rng.random() < 0.6, START + timedelta(minutes=rng.randrange(40)))
        for i in range(n)
    ]
    rng.shuffle(rows)
    return rows


def streamed(spark, run_dir, rows, files, before, employees, **options):
    size = -(-len(rows) // files)
    for n in range(files):
        part = spark.createDataFrame(rows[n * size : (n + 1) * size], SUBMISSIONS)
        part.coalesce(1).write.mode("append").parquet(run_dir + "/in")
    source = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(run_dir + "/in")
    saving.save_stream(source, before, employees, run_dir + "/out", run_dir + "/ck", **options).awaitTermination()
    return saving.saved_employees(spark, run_dir + "/out", employees), streams.current_progress(spark, run_dir + "/out/progress", before)


def flat(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("rule,compact_every,seed", [("sticky", None, 1), ("regressing", 1, 2), ("sticky", 2, 3)])
def test_any_arrival_gives_the_batch_save(spark, run_dir, employees, monkeypatch, rule, compact_every, seed):
    rng = random.Random(seed)
    earlier = [(-n - 1, e, m, "old", True, START - timedelta(days=1)) for e in (3, 5) for n, m in enumerate(MODULES[: 3 if e == 3 else 12])]
    before = progress.module_progress(spark.createDataFrame(earlier, SUBMISSIONS))
    rows = some_submissions(rng, 80)
    if rule == "regressing":
        employees = employees.withColumn("completion_status", F.lit("completed"))
    staff, saved = streamed(spark, run_dir, rows, 4, before, employees, rule=rule, compact_every=compact_every)
    want_saved, want_staff, want_rejects = progress.save_progress(
        spark.createDataFrame(rows, SUBMISSIONS), before, employees, rule
    )
    columns = ["id", "progress_pct", "completion_status"]
    assert flat(staff.select(columns)) == flat(want_staff.select(columns))
    assert flat(saved) == flat(want_saved.select(saved.columns))
    rejects = ChangeFolders(run_dir + "/out/rejects", ("submission_id",)).read(spark)
    assert flat(rejects.select("submission_id", "reason")) == flat(want_rejects.select("submission_id", "reason"))


def test_a_stream_goes_on_from_its_state(spark, run_dir, employees):
    rows = sorted(some_submissions(random.Random(7), 60, staff=(3, 4)), key=lambda r: -r[0])
    none = spark.createDataFrame([], SUBMISSIONS)
    before = progress.module_progress(none)
    streamed(spark, run_dir, rows[:30], 2, before, employees)
    staff, saved = streamed(spark, run_dir, rows[30:], 2, before, employees)
    want_saved, want_staff, _ = progress.save_progress(spark.createDataFrame(rows, SUBMISSIONS), before, employees)
    assert flat(saved) == flat(want_saved.select(saved.columns))
    assert by(staff, "id")[3].completion_status == by(want_staff, "id")[3].completion_status


def test_late_rows_and_rows_over_the_range_are_rejected(spark, run_dir, employees):
    day = timedelta(days=1)
    rows = [(1, 3, "ppe", "{}", True, START + 9 * day), (2, 3, "ppe", "{}", False, START), (3, 3, "fire", "{}", True, START + 8 * day)]
    full = [(-n - 1, 4, m, "old", True, START) for n, m in enumerate(MODULES)]
    rows += [(4, 4, "extra", "{}", True, START + day)]
    before = progress.module_progress(spark.createDataFrame(full, SUBMISSIONS))
    week = 7 * 24 * 3600 * 1_000_000
    staff, saved = streamed(spark, run_dir, rows, 4, before, employees, lateness=week)
    rejects = by(ChangeFolders(run_dir + "/out/rejects", ("submission_id",)).read(spark), "submission_id")
    # Files are read in the order they were written, but two of one moment may swap.
    assert rejects[4].reason == "progress_pct:range" and set(rejects) in ({4}, {2, 4})
    if 2 in rejects:
        assert rejects[2].reason == "submitted_at:late"
    assert by(staff, "id")[4].progress_pct == 25
    assert (by(staff, "id")[3].progress_pct, saved.where("employee_id = 3").count()) == (17, 2)


def test_state_forgets_only_what_nothing_can_go_before():
    rng = random.Random(11)
    for _ in range(200):
        saves = sorted((rng.randrange(50), i, rng.choice("abc"), rng.random() < 0.5) for i in range(20))
        whole, folded = saving.SavedEmployee("completed"), saving.SavedEmployee("completed")
        for at, i, module, done in saves:
            whole.save(at, i, module, "", done)
            folded.save(at, i, module, "", done)
            if rng.random() < 0.3:
                folded.fold(at)
                folded = saving.SavedEmployee(*folded.stored())
        assert whole.replayed() == folded.replayed()
        assert len(folded.entries) <= len(whole.entries)


def test_rows_that_lack_a_value_have_a_stream_of_their_own(spark, run_dir):
    rows = [(1, None, "ppe", "{}", True, START), (2, 3, "ppe", None, True, START), (3, 3, "ppe", "{}", True, START)]
    spark.createDataFrame(rows, SUBMISSIONS).write.parquet(run_dir + "/in")
    source = spark.readStream.schema(SUBMISSIONS).parquet(run_dir + "/in")
    saving.lacking_stream(source, run_dir + "/out", run_dir + "/ck").awaitTermination()
    out = ChangeFolders(run_dir + "/out/lacking", ("submission_id",)).read(spark)
    assert {r.submission_id: r.reason for r in out.collect()} == {1: "employee_id:not_null", 2: "answers:not_null"}


def test_streamed_queries_equal_the_batch(spark):
    sf = "/root/testdata/sf0.001"
    assert flat(QUERIES["save_stream_employees"](spark, sf)) == flat(QUERIES["save_progress_employees"](spark, sf))
