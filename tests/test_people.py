import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from inductra.operators import audit, people, tables

from rows import by

EDITS = """edit_id bigint, emp_id bigint, actor_auth_id bigint, edited_at timestamp_ntz,
    full_name string, phone string, age int, position string, department string"""
RUN = datetime(2025, 1, 1)


def run_ts():
    return F.lit(RUN).cast("timestamp_ntz")


def edits(spark, rows):
    return spark.createDataFrame(rows, EDITS)


def edit(i, emp, actor=101, name="New", phone="1", age=20, day=1):
    return (i, emp, actor, datetime(2024, 6, day), name, phone, age, "Driver", "Yard")


def test_old_values_come_from_the_stored_row_then_from_the_edit_before(spark, employees):
    allowed, _ = people.judge_edits(edits(spark, [edit(2, 4, name="Second", day=2), edit(1, 4, name=None)]), employees)
    log = by(people.edit_audit(allowed, employees), "id")
    assert json.loads(log[1].old_value) == {
        "full_name": "Dee", "phone": "", "age": None, "position": "Employee", "department": "Store",
    }
    assert json.loads(log[1].new_value)["full_name"] is None
    assert json.loads(log[2].old_value) == json.loads(log[1].new_value)
    assert (log[1].actor_id, log[1].actor_name, log[1].actor_role) == (1, "Ann", "sysAdmin")


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_one_employee_with_most_edits(spark, employees, hot_rows):
    rows = [edit(i, 4 if i % 3 else 3, name=f"N{i}", day=1 + i % 7) for i in range(60)]
    allowed, _ = people.judge_edits(edits(spark, rows), employees)
    log = by(people.edit_audit(allowed, employees, hot_rows), "id")
    for emp, first in ((3, "Cyd"), (4, "Dee")):
        chain = sorted((r for r in rows if r[1] == emp), key=lambda r: (r[3], r[0]))
        names = [first, *(r[4] for r in chain)]
        assert [json.loads(log[r[0]].old_value)["full_name"] for r in chain] == names[:-1]


def test_only_administrators_edit_and_only_known_employees(spark, employees):
    rows = [edit(1, 4, actor=102), edit(2, 99), edit(3, 4, actor=999), edit(4, 4), edit(5, 4, actor=None)]
    allowed, rejected = people.judge_edits(edits(spark, rows), employees)
    assert {i: r.reason for i, r in by(rejected, "edit_id").items()} == {
        1: people.DENIED, 2: "emp_id:foreign_key", 3: people.DENIED, 5: people.DENIED,
    }
    assert [r.id for r in people.edit_audit(allowed, employees).collect()] == [4]


def test_last_edit_wins_and_locked_dates_stay(spark, employees):
    allowed, _ = people.judge_edits(
        edits(spark, [edit(1, 4, name="A", day=3), edit(2, 4, name="B", day=2), edit(3, 99)]), employees
    )
    out = by(people.apply_profile_edits(employees, allowed, run_ts()), "id")
    assert (out[4].full_name, out[4].updated_at) == ("A", RUN)
    assert out[4].start_date == out[3].start_date
    assert out[3].updated_at == datetime(2024, 1, 1)
    assert len(out) == 5


def test_an_edit_may_set_null(spark, employees):
    allowed, _ = people.judge_edits(edits(spark, [edit(1, 3, phone=None)]), employees)
    assert by(people.apply_profile_edits(employees, allowed, run_ts()), "id")[3].phone is None


def test_merge_inserts_and_ignores_locked_columns_on_update(spark, employees):
    changes = spark.sql("""
        SELECT CAST(id AS BIGINT) AS id, name AS full_name, DATE '2030-01-01' AS start_date
        FROM VALUES (4, 'Dora'), (9, 'Ian') AS t(id, name)""")
    out = by(tables.merge_snapshot(employees, changes, "id", run_ts()), "id")
    assert (out[4].full_name, str(out[4].start_date)) == ("Dora", "2024-01-01")
    assert (out[9].full_name, str(out[9].start_date), out[9].phone) == ("Ian", "2030-01-01", None)
    assert len(out) == 6


def test_field_changes(spark, employees):
    allowed, _ = people.judge_edits(edits(spark, [(1, 3, 101, RUN, "Cyd", None, 29, "Employee", "Store")]), employees)
    types = {"full_name": "string", "phone": "string", "age": "int", "position": "string", "department": "string"}
    changes = audit.audit_changes(people.edit_audit(allowed, employees), types)
    assert sorted((r.field, r.old, r.new) for r in changes.collect()) == [("age", "28", "29"), ("phone", "043", None)]


def test_values_wrapped_as_json_text_are_unwrapped(spark):
    df = spark.createDataFrame([(json.dumps('{"a":1}'),), ('{"a":1}',), (None,)], "v string")
    assert [r[0] for r in df.select(audit.unwrap_json("v")).collect()] == ['{"a":1}', '{"a":1}', None]


def test_unknown_actor_still_leaves_an_entry(spark, employees):
    entries = spark.createDataFrame([(1, 999, "x"), (2, 102, "y"), (3, None, "z")], "id bigint, actor_auth_id bigint, action string")
    out = by(audit.write_audit(entries, employees), "id")
    assert (out[1].actor_id, out[1].actor_name, out[1].actor_role) == (None, None, None)
    assert (out[2].actor_id, out[2].actor_name) == (2, "Bob")
    assert len(out) == 3


def test_latest_entries_are_newest_first(spark):
    df = spark.range(50).select("id", F.timestamp_seconds(F.col("id") % 30).alias("created_at"))
    got = [r.id for r in audit.audit_latest(df).collect()]
    want = sorted(range(50), key=lambda i: (-(i % 30), i))[:20]
    assert got == want
    plan = audit.audit_latest(df)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def deletions(spark, rows):
    return spark.createDataFrame(
        [(*r, datetime(2024, 7, 1 + r[0])) for r in rows],
        "deletion_id bigint, emp_id bigint, actor_auth_id bigint, deleted_at timestamp_ntz",
    )


def test_deletion_takes_everything_along(spark, employees, users):
    batch = people.Deletion(deletions(spark, [(1, 3, 101), (2, 5, 101), (3, 4, 102), (4, 3, 101)]), employees)
    progress = spark.createDataFrame([(3, "ppe"), (4, "ppe")], "employee_id bigint, module_id string")
    log = spark.createDataFrame([(1, 3, 4), (2, 1, 3)], "id bigint, actor_id bigint, target_id bigint")
    assert sorted(by(batch.remaining_employees(), "id")) == [1, 2, 4]
    assert [r.employee_id for r in batch.remaining_progress(progress).collect()] == [4]
    assert sorted(by(batch.remaining_users(users), "id")) == [101, 102, 105, 106]
    old = by(batch.without_references(log), "id")
    assert (old[1].actor_id, old[1].target_id, old[2].actor_id, old[2].target_id) == (None, 4, 1, None)
    assert sorted((r.detail or "") for r in batch.entries().collect()) == ["", "Deleted: Cyd"]
    assert [r.deletion_id for r in batch.rejected.collect()] == [3]


def test_self_deletion(spark, employees):
    batch = people.Deletion(deletions(spark, [(1, 1, 101)]), employees)
    entry = batch.entries("before").first()
    assert (entry.actor_id, entry.actor_name, entry.detail) == (None, "Ann", "Deleted: Ann")
    assert batch.entries("after").count() == 0


def test_induction_record(spark):
    rows = [
        (1, 1, "start", 1), (2, 2, "complete", 1), (3, 2, "start", 2),
        (4, 3, "complete", 1), (5, 3, "complete", 5), (6, 4, "open", 1),
    ]
    df = spark.createDataFrame(
        [(i, e, a, datetime(2024, 1, d)) for i, e, a, d in rows],
        "event_id bigint, employee_id bigint, action string, happened_at timestamp_ntz",
    )
    out = by(people.induction_state(df), "employee_id")
    assert (out[1].status, out[1].progress_percent, out[1].declaration_accepted) == ("in_progress", 10, False)
    assert (out[2].status, out[2].progress_percent, out[2].current_module) == ("in_progress", 100, people.START_MODULE)
    assert out[2].completed_at == datetime(2024, 1, 1)
    assert (out[3].status, out[3].completed_at) == ("completed", datetime(2024, 1, 5))
    assert 4 not in out


def test_ensure_rows_adds_only_missing(spark):
    keys = spark.createDataFrame([(1,), (2,), (2,)], "k bigint")
    existing = spark.createDataFrame([(1, "done")], "k bigint, s string")
    out = tables.ensure_rows(keys, existing, "k", {"s": F.lit("new")})
    assert sorted(tuple(r) for r in out.collect()) == [(1, "done"), (2, "new")]


def test_actions(spark, employees):
    rows = [(1, 2, "activate", 1), (2, 2, "inactive", 2), (3, 3, "delete", 1), (4, 3, "activate", 9), (5, 4, "activate", 1)]
    acts = spark.createDataFrame(
        [(i, e, a, datetime(2024, 1, d)) for i, e, a, d in rows],
        "action_id bigint, emp_id bigint, action string, acted_at timestamp_ntz",
    )
    out = by(people.employee_actions(employees, acts), "id")
    assert {i: r.status for i, r in out.items()} == {1: "invited", 2: "inactive", 4: "active", 5: "invited"}


def test_forms(spark):
    df = spark.createDataFrame(
        [
            (1, "sys_admin", " A\t", " a@x ", " \n", "D ", " P", "location_manager"),
            (2, "location_manager", "B", "b@x", " 04 ", "D", "P", "sys_admin"),
            (3, "employee", "C", "c@x", "", "D", "P", "employee"), (4, None, "D", "d@x", "", "D", "P", "employee"),
        ],
        "form_id int, actor_role string, full_name string, email string, phone string, department string, position string, role string",
    )
    accepted, rejected = people.create_from_forms(df)
    out = by(accepted, "form_id")
    assert (out[1].full_name, out[1].email, out[1].phone, out[1].role) == ("A", "a@x", None, "location_manager")
    assert (out[2].phone, out[2].role, out[2].status) == ("04", "employee", "invited")
    assert sorted(by(rejected, "form_id")) == [3, 4]


def test_defaults_fill_missing_columns_not_nulls(spark):
    df = spark.createDataFrame([(None,)], "role string")
    row = tables.with_defaults(df, {"role": F.lit("employee"), "progress_pct": F.lit(0)}).first()
    assert (row.role, row.progress_pct) == (None, 0)


def test_older_portal_actions_need_their_role(spark, employees):
    rows = [(1, 3, "delete", 101), (2, 3, "delete", 102), (3, 4, "activate", 102), (4, 4, "inactive", 103),
            (5, 4, "activate", 999), (6, 4, "delete", None)]
    acts = spark.createDataFrame(
        [(i, e, a, who, datetime(2024, 1, 1)) for i, e, a, who in rows],
        "action_id bigint, emp_id bigint, action string, actor_auth_id bigint, acted_at timestamp_ntz",
    )
    allowed, rejected = people.judge_actions(acts, employees)
    assert sorted(r.action_id for r in allowed.collect()) == [1, 3]
    assert {r.action_id: r.reason for r in rejected.collect()} == {i: "Permission denied" for i in (2, 4, 5, 6)}
