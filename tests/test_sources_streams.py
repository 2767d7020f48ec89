import json
import os
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from inductra.operators import progress, tables
from inductra.operators.progress import KEY
from inductra.schemas import MODULES, ROSTER_COLUMNS
from inductra.session import run_folder, shared_folder
from inductra.sources import tables as sources
from inductra.sources.fixtures import fixture
from inductra.streaming import streams
from inductra.streaming.folders import ChangeFolders, IdIndex

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def test_shared_folder_is_the_sessions_setting(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        assert shared_folder(spark) == folder.rstrip("/")
    assert run_folder(spark, "x") != run_folder(spark, "x")


def test_a_cluster_must_name_its_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return default

    cluster = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(cluster)


def test_catalogue(spark):
    assert [r.module_id for r in sources.catalogue(spark).orderBy("idx").collect()] == list(MODULES)


def test_request_bodies_with_missing_fields(spark, run_dir):
    bodies = [
        {"request_id": 1, "question": "q", "products": [{"name": "A"}, {"name": ""}], "candidates": [{"id": 1, "name": "A"}]},
        {"request_id": 2, "staffPhoto": "x", "product": {"name": "B"}, "textOnlyMode": True},
    ]
    with open(run_dir + "/b.json", "w") as out:
        out.write("\n".join(json.dumps(b) for b in bodies))
    rows = {r.request_id: r for r in sources.read_requests(spark, run_dir + "/b.json").collect()}
    assert (rows[1].n_candidates, rows[1].product_name, rows[1].products[0].name) == (1, None, "A")
    assert (rows[2].n_candidates, rows[2].product_name, rows[2].text_only, rows[2].staff_photo) == (0, "B", True, "x")


def test_reply_bodies(spark):
    body = json.dumps({"candidates": [{"content": {"parts": [{"text": "\n hi "}]}}]})
    df = spark.createDataFrame([(body,), ("{}",)], "body string")
    assert [r.reply_text for r in sources.with_reply_text(df).collect()] == ["hi", ""]


def test_audit_log_is_appended_by_day(spark, run_dir):
    entries = spark.range(10).select("id", F.lit("x").alias("action"), F.timestamp_seconds(F.col("id") * 30_000).alias("created_at"))
    sources.append_audit(entries, run_dir + "/log", "one")
    for _ in range(2):
        sources.append_audit(entries.withColumn("id", F.col("id") + 10), run_dir + "/log", "two")
    log = spark.read.parquet(run_dir + "/log")
    assert sorted(r.id for r in log.collect()) == list(range(20))
    plan = log.filter("audit_date = DATE '1970-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(audit_date" in plan


def test_tables_in_the_same_buckets_join_without_a_shuffle(spark, run_dir):
    employees = fixture(spark, SF, "fx_employees").select("id", "completion_status", "progress_pct")
    flags = progress.completion_flags(fixture(spark, SF, "fx_submissions")).withColumnRenamed("employee_id", "id")
    sources.save_bucketed(employees, "b_employees", run_dir + "/employees", "id", 4)
    sources.save_bucketed(flags, "b_progress", run_dir + "/progress", "id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        saved = spark.table("b_progress").withColumnRenamed("id", "employee_id")
        out = progress.progress_pct(saved, spark.table("b_employees"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        want = progress.progress_pct(flags.withColumnRenamed("id", "employee_id"), employees)
        assert rows_of(out) == rows_of(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE b_employees")
        spark.sql("DROP TABLE b_progress")


def test_snapshot_versions(spark, run_dir):
    root = run_dir + "/employees"
    clock = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp_ntz")
    sources.write_snapshot(spark.range(3), root, "one", clock(1))
    first = sources.read_snapshot(spark, root)
    sources.write_snapshot(first.withColumn("id", F.col("id") + 1), root, "two", clock(2))
    assert sorted(r.id for r in sources.read_snapshot(spark, root).collect()) == [1, 2, 3]
    with pytest.raises(Exception):
        sources.write_snapshot(spark.range(1), root, "two", clock(3))


def test_roster_lines_keep_nulls_and_order(spark, run_dir):
    staff = fixture(spark, SF, "fx_employees")
    tables_json = tables.roster_json(staff)
    sources.write_json_lines(tables_json, run_dir + "/roster")
    lines = [json.loads(r.value) for r in spark.read.text(run_dir + "/roster").collect()]
    assert len(lines) == staff.count()
    assert list(lines[0]) == list(ROSTER_COLUMNS)
    assert any(line["age"] is None for line in lines)
    assert sources_empty(spark, run_dir) == 0


def sources_empty(spark, run_dir):
    staff = fixture(spark, SF, "fx_employees").limit(0)
    sources.write_json_lines(tables.roster_json(staff), run_dir + "/none")
    return spark.read.text(run_dir + "/none").count()


def write_events(spark, rows, path, files):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    for n in range(files):
        spark.createDataFrame(rows[n::files], schema).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")


def test_progress_stream_equals_the_batch_in_any_arrival_order(spark, run_dir):
    rng = random.Random(3)
    start = datetime(2024, 3, 1)
    rows = [
        (i, start + timedelta(hours=rng.randrange(48)), rng.randrange(5), rng.choice(["purchase", "view"]), 1.0, f"a{i}")
        for i in range(90)
    ]
    rng.shuffle(rows)
    write_events(spark, rows, run_dir, 4)
    stream = streams.submissions_of(streams.event_stream(spark, run_dir, files_per_batch=1))
    query = streams.progress_stream(stream, run_dir + "/out", run_dir + "/ck")
    query.awaitTermination()
    batches = spark.read.parquet(run_dir + "/out").select("batch").distinct().count()
    assert batches >= 3
    batch = progress.module_progress(streams.submissions_of(spark.read.parquet(run_dir + "/events.parquet")))
    got = streams.current_progress(spark, run_dir + "/out")
    assert rows_of(got.select(batch.columns)) == rows_of(batch)


def test_progress_stream_goes_on_after_a_stop(spark, run_dir):
    start = datetime(2024, 3, 1)
    rows = [(i, start + timedelta(minutes=37 * i), i % 3, "purchase" if i % 4 else "view", 1.0, f"a{i}") for i in range(60)]
    def run():
        stream = streams.submissions_of(streams.event_stream(spark, run_dir, files_per_batch=1))
        streams.progress_stream(stream, run_dir + "/out", run_dir + "/ck").awaitTermination()

    write_events(spark, rows[30:], run_dir, 2)
    run()
    early = streams.current_progress(spark, run_dir + "/out")
    before = rows_of(early)
    assert ChangeFolders(run_dir + "/out", KEY).compact(spark) is not None
    assert rows_of(streams.current_progress(spark, run_dir + "/out")) == before
    write_events(spark, rows[:30], run_dir, 2)
    run()
    batch = progress.module_progress(streams.submissions_of(spark.read.parquet(run_dir + "/events.parquet")))
    assert rows_of(streams.current_progress(spark, run_dir + "/out").select(batch.columns)) == rows_of(batch)


def test_files_read_do_not_grow_with_batches(spark, run_dir):
    """Twelve batches, folded every two: a base and two change folders at most, whatever was written."""
    start = datetime(2024, 3, 1)
    rows = [(i, start + timedelta(minutes=11 * i), i % 4, "purchase" if i % 3 else "view", 1.0, f"a{i}") for i in range(96)]
    random.Random(1).shuffle(rows)
    write_events(spark, rows, run_dir, 12)
    stream = streams.submissions_of(streams.event_stream(spark, run_dir, files_per_batch=1))
    streams.progress_stream(stream, run_dir + "/out", run_dir + "/ck", compact_every=2).awaitTermination()
    folders = ChangeFolders(run_dir + "/out", KEY)
    base, batches = folders.live(spark)
    assert base == 10 and batches == [11]
    found = folders.listed(spark)
    assert len(found["base"]) <= 2 and len(found["batch"]) <= 4
    batch = progress.module_progress(streams.submissions_of(spark.read.parquet(run_dir + "/events.parquet")))
    got = folders.read(spark)
    assert len(got.inputFiles()) <= 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows_of(got.select(batch.columns)) == rows_of(batch)


def test_a_base_without_its_marker_does_not_count(spark, run_dir):
    folders = ChangeFolders(run_dir + "/t", ("k",))
    assert folders.read(spark) is None and folders.compact(spark) is None
    for n, values in enumerate(([(1, "a"), (2, "a")], [(2, "b")], [(3, "c")])):
        folders.write(spark.createDataFrame(values, "k bigint, v string"), n)
    assert folders.compact(spark) == 2
    os.remove(run_dir + "/t/base=2/_SUCCESS")
    assert folders.live(spark) == (None, [0, 1, 2])
    assert folders.compact(spark) == 2
    folders.write(spark.createDataFrame([(1, "d")], "k bigint, v string"), 3)
    assert rows_of(folders.read(spark)) == [(1, "d"), (2, "b"), (3, "c")]
    assert folders.compact(spark) == 3 and folders.listed(spark)["batch"] == [3]
    assert rows_of(folders.read(spark)) == [(1, "d"), (2, "b"), (3, "c")]


def test_audit_stream_writes_each_id_once(spark, run_dir):
    start = datetime(2024, 3, 1, 23, 30)
    rows = [(i % 20, start + timedelta(minutes=2 * (i % 20)), 1, "view", 1.0, "{}") for i in range(40)]
    write_events(spark, rows, run_dir, 2)
    entries = streams.audit_entries_of(streams.event_stream(spark, run_dir, files_per_batch=1))
    streams.audit_stream(entries, run_dir + "/log", run_dir + "/ck").awaitTermination()
    log = spark.read.parquet(run_dir + "/log")
    assert sorted(r.id for r in log.collect()) == list(range(20))
    assert log.select("audit_date").distinct().count() == 2


def test_audit_stream_writes_late_entries(spark, run_dir):
    """Four files of five ids each, days 10, 11, 9 and 8, one file per batch."""
    start = datetime(2024, 3, 1)
    rows = [(5 * k + i, start + timedelta(days=day, minutes=i), 1, "view", 1.0, "{}")
            for i in range(5) for k, day in enumerate((10, 11, 9, 8))]
    write_events(spark, rows, run_dir, 4)
    entries = streams.audit_entries_of(streams.event_stream(spark, run_dir, files_per_batch=1))
    streams.audit_stream(entries, run_dir + "/log", run_dir + "/ck").awaitTermination()
    streams.audit_stream(entries, run_dir + "/log", run_dir + "/ck2").awaitTermination()
    log = spark.read.parquet(run_dir + "/log")
    assert sorted(r.id for r in log.collect()) == list(range(20))


def test_an_id_comes_once_whatever_its_day(spark, run_dir):
    """Repeats carry another day; a crash behind the log, before the index, leaves nothing twice."""
    start = datetime(2024, 3, 1)

    def deliver(days, ids, files=1):
        rows = [(i, start + timedelta(days=days, minutes=i or 0), 1, "view", 1.0, f"d{days}") for i in ids]
        write_events(spark, rows, run_dir, files)

    def run():
        entries = streams.audit_entries_of(streams.event_stream(spark, run_dir, files_per_batch=1))
        query = streams.audit_stream(entries, run_dir + "/log", run_dir + "/ck", buckets=8, compact_every=2)
        query.awaitTermination()

    deliver(0, range(10))
    run()
    deliver(5, range(5, 15), 2)
    run()
    deliver(-400, range(20), 3)
    deliver(1, [None, None])
    run()
    log = spark.read.parquet(run_dir + "/log")
    days = {r.id: r.audit_date.day for r in log.where("id IS NOT NULL").collect()}
    assert log.where("id IS NOT NULL").count() == 20 and log.where("id IS NULL").count() == 2
    assert {i: days[i] for i in range(15)} == {i: 1 if i < 10 else 6 for i in range(15)}
    index = IdIndex(run_dir + "/log_ids", "bigint", 8)
    base, batches = index.live(spark)
    assert base is not None and len(batches) <= 2
    assert sorted(r.id for r in index.read(spark).collect()) == list(range(20))
    # Batch numbers go on, so a batch sees only what came before it.
    seen = index.unknown(spark.createDataFrame([(3,), (77,), (None,)], "id bigint"), 10**6).collect()
    assert sorted(r.id or -1 for r in seen) == [-1, 77]


def test_a_batch_reads_only_its_buckets(spark, run_dir):
    index = IdIndex(run_dir + "/ids", "bigint", 64)
    index.write(spark.range(5000).repartition(3), 0)
    rows = spark.createDataFrame([(5,), (6000,)], "id bigint")
    plan = index.unknown(rows, 1)
    assert [r.id for r in plan.collect()] == [6000]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in text and "In(id" in text or "EqualTo(id" in text or "id IN" in text
    assert index.unknown(rows, 0).count() == 2


def test_versions_of_one_clock_keep_their_order(spark, run_dir):
    root = run_dir + "/table"
    clock = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    for n, run_id in enumerate(("run-b", "run-a", "run-c")):
        sources.write_snapshot(spark.range(n + 1), root, run_id, clock)
        assert sources.read_snapshot(spark, root).count() == n + 1


def test_a_repeated_append_leaves_no_days_behind(spark, run_dir):
    entries = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2))], "id bigint, created_at timestamp_ntz")
    other = spark.createDataFrame([(3, datetime(2024, 1, 1))], entries.schema)
    sources.append_audit(other, run_dir + "/log", "zero")
    sources.append_audit(entries, run_dir + "/log", "one")
    sources.append_audit(entries.where("id = 1"), run_dir + "/log", "one")
    assert sorted(r.id for r in spark.read.parquet(run_dir + "/log").collect()) == [1, 3]
