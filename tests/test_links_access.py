import pytest
from pyspark.sql import functions as F

from inductra.operators import access, links, onboarding, rules, tables
from inductra.schemas import MODULES, ROLES, ROSTER_COLUMNS

from rows import by


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# Links ---------------------------------------------------------------------------


def test_email_lookup_ignores_case_and_outer_spaces(spark, employees, users):
    lookups = frame(spark, [(1, " emp100001 "), (2, "EMP100002"), (3, "EMP100004"), (4, "EMP100005"), (5, "x"), (6, None)], "lookup_id int, code string")
    out = by(links.email_by_code(lookups, employees, users), "lookup_id")
    assert {i: r.email for i, r in out.items()} == {
        1: "ann@example.com", 2: "Bob@Example.com", 3: None, 4: None, 5: None, 6: None,
    }


def test_codes_equal_but_for_case_give_the_smallest_id(spark, users):
    staff = frame(spark, [(9, 103, "Emp1"), (8, 101, "EMP1"), (7, 999, "emp1")], "id bigint, auth_id bigint, employee_code string")
    lookups = frame(spark, [(1, "emp1")], "lookup_id int, code string")
    assert links.email_by_code(lookups, staff, users).first().email == "ann@example.com"


@pytest.mark.parametrize(
    "shape,columns",
    [
        ("raw", ["id", "employee_code", "full_name", "role", "department", "auth_id", "email", "email_confirmed_at"]),
        ("flags", ["id", "employee_code", "full_name", "role", "has_auth", "email", "is_confirmed"]),
        ("linked", ["id", "employee_code", "full_name", "role", "email", "confirmed", "linked"]),
    ],
)
def test_link_report_shapes(spark, employees, users, shape, columns):
    out = links.link_report(employees, users, shape)
    assert out.columns == columns
    assert out.count() == 5


def test_link_report_flags(spark, employees, users):
    out = by(links.link_report(employees, users), "id")
    assert (out[2].has_auth, out[2].is_confirmed) == (True, False)
    assert (out[4].has_auth, out[4].email) == (True, None)
    assert (out[5].has_auth, out[5].is_confirmed) == (False, False)


def test_unlinked_employees_are_spread(spark, users, run_dir):
    spark.range(2000).selectExpr("id", "CAST(NULL AS BIGINT) AS auth_id").write.parquet(run_dir + "/staff")
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for key, value in off.items():
        spark.conf.set(key, value)
    try:
        joined = links.left_join_by_link(spark.read.parquet(run_dir + "/staff"), users)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key in off:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 2000 and max(sizes) < 1000


def test_relink(spark, employees, users):
    wanted = frame(
        spark,
        [(3, " CYD@example.com"), (5, "eve@example.com"), (4, "EVE@example.com "), (2, "ann@example.com"), (1, "none@example.com")],
        "employee_id bigint, email string",
    )
    changed, rejected = links.relink(wanted, employees, users)
    assert sorted(tuple(r) for r in changed.collect()) == [(4, 104, 105)]
    assert {i: r.reason for i, r in by(rejected, "employee_id").items()} == {2: "already_linked", 5: "claimed_in_batch"}


# Reads ---------------------------------------------------------------------------


def test_cardinality_classes(spark):
    keys = frame(spark, [(1,), (2,), (3,), (3,)], "k int")
    rows = frame(spark, [(2,), (3,), (3,), (9,)], "k int")
    out = by(tables.key_cardinality(rows, keys, "k"), "k")
    assert {k: (r.n_rows, r.cardinality) for k, r in out.items()} == {1: (0, "none"), 2: (1, "one"), 3: (2, "many")}


def test_sort_orders(spark):
    df = spark.sql("SELECT * FROM VALUES (2, 5), (1, 5), (3, NULL), (4, 9) AS t(id, created_at)")
    assert [r.id for r in tables.newest_first(df).collect()] == [3, 4, 1, 2]
    assert [r.id for r in tables.oldest_first(df).collect()] == [1, 2, 4, 3]


def test_equality_read_reaches_the_scan(spark, run_dir):
    spark.sql("SELECT id, CAST(id AS STRING) AS role, 'x' AS wide FROM range(10)").write.parquet(run_dir + "/t")
    found = tables.select_where(spark.read.parquet(run_dir + "/t"), "role", "3", ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,3)" in plan and "wide" not in plan
    assert [r.id for r in found.collect()] == [3]


# Access --------------------------------------------------------------------------


def viewers(spark):
    return frame(spark, [(101,), (102,), (103,), (999,)], "viewer_auth_id bigint")


def test_visible_counts(spark, employees):
    progress = frame(spark, [(3, "a"), (3, "b"), (4, "a")], "employee_id bigint, module_id string")
    out = by(access.visible_counts(progress, viewers(spark), employees, "module_progress", "employee_id"), "viewer_auth_id")
    assert {v: (r.scope, r.visible_rows) for v, r in out.items()} == {
        101: ("all", 3), 102: ("all", 3), 103: ("own", 2), 999: ("none", 0),
    }
    log = frame(spark, [(1, 3)], "id int, target_id bigint")
    out = by(access.visible_counts(log, viewers(spark), employees, "audit_logs", "target_id"), "viewer_auth_id")
    assert {v: r.visible_rows for v, r in out.items()} == {101: 1, 102: 0, 103: 0, 999: 0}


@pytest.mark.parametrize("viewer,ids", [(101, [1, 2, 3, 4, 5]), (102, [1, 2, 3, 4, 5]), (103, [3]), (999, []), (None, [])])
def test_rows_of_one_viewer(spark, employees, viewer, ids):
    assert sorted(by(access.visible(employees, employees, viewer, "employees"), "id")) == ids


def test_dashboard_is_for_managers(spark, users):
    from inductra.sources.fixtures import fixture

    staff = fixture(spark, "/root/testdata/sf0.001", "fx_employees")
    assert access.dashboard(staff, 100050).columns == list(ROSTER_COLUMNS)
    for viewer in (100001, -5, None):
        with pytest.raises(PermissionError):
            access.dashboard(staff, viewer)


def test_own_rows_leave_managers_out(spark, employees):
    progress = frame(spark, [(1, "a"), (3, "b"), (4, "a")], "employee_id bigint, module_id string")
    out = access.own_rows(progress, viewers(spark), employees, "module_progress", "employee_id")
    assert [(r.employee_id, r.viewer_auth_id) for r in out.collect()] == [(3, 103)]


def test_no_pairs_are_made_for_counts(spark, employees):
    progress = frame(spark, [(3, "a")], "employee_id bigint, module_id string")
    plan = access.visible_counts(progress, viewers(spark), employees, "module_progress", "employee_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text


@pytest.mark.parametrize(
    "table,action,expected",
    [
        ("employees", "update", {101: True, 102: True, 103: False, 104: True, 999: False, None: False}),
        ("employees", "insert", {101: True, 102: False, 103: False, 104: False, 999: False, None: False}),
        ("module_progress", "update", {101: False, 102: False, 103: False, 104: True, 999: False, None: False}),
        ("audit_logs", "insert", {101: True, 102: True, 103: True, 104: True, 999: True, None: False}),
        ("audit_logs", "delete", {101: False, 102: False, 103: False, 104: False, 999: False, None: False}),
    ],
)
def test_write_policies_fail_closed(spark, employees, table, action, expected):
    changes = frame(spark, [(v, 4) for v in expected], "viewer_auth_id bigint, owner bigint")
    out = access.authorised(changes, employees, table, action, "owner")
    assert {r.viewer_auth_id: r.allowed for r in out.collect()} == expected
    refused = {r.outcome for r in out.collect() if not r.allowed}
    assert refused == {"rejected" if action == "insert" else "no_rows"}


def test_broadcast_only_below_the_bound(spark, employees):
    hint = lambda d: "broadcast" in d._jdf.queryExecution().analyzed().toString().lower()
    assert hint(access.identities_with(employees, ("employee",), 2))
    assert not hint(access.identities_with(employees, ("employee",), 1))



# Rules ---------------------------------------------------------------------------


def test_rules(spark):
    staff = frame(
        spark,
        [(1, "A", "x", "employee", 0, 10), (2, "A", None, "owner", 101, 11), (3, None, "z", None, None, None), (4, None, "y", "sysAdmin", -1, 10)],
        "id int, code string, name string, role string, pct int, link int",
    )
    parent = frame(spark, [(10,), (12,)], "id int")
    out = rules.all_violations(
        rules.row_violations(staff, "id", [rules.not_null("name"), rules.in_range("pct", 0, 100), rules.in_domain("role", ROLES)]),
        rules.unique(staff, "code"),
        rules.unique(staff, "code", "link"),
        rules.foreign_key(staff, "link", parent, "id"),
        rules.in_catalogue(staff.withColumnRenamed("name", "module_id"), "module_id", (*MODULES, "x", "y")),
    )
    assert sorted(tuple(r) for r in out.collect()) == [
        ("code:unique", "A", 2), ("link:foreign_key", "11", 1), ("module_id:catalogue", "z", 1),
        ("name:not_null", "2", 1), ("pct:range", "2", 1), ("pct:range", "4", 1), ("role:domain", "2", 1),
    ]


# Onboarding ----------------------------------------------------------------------

REQUESTS = "request_id bigint, actor_auth_id bigint, email string, password_length int"


def requests(spark):
    return frame(
        spark,
        [
            (1, 101, " Eve@Example.com ", 8), (2, 101, "eve@example.com", 8), (3, 102, "new@example.com", 8),
            (4, 101, "  ", 8), (5, 101, None, 8), (6, 101, "new@example.com", 5), (7, 101, "new@example.com", 6),
            (8, 101, "cyd@example.com", 9), (9, 999, "new@example.com", 9), (10, 101, "new@example.com", None),
        ],
        REQUESTS,
    )


@pytest.mark.parametrize(
    "mode,expected",
    [
        (
            "find_or_create",
            {1: None, 2: onboarding.REPEATED, 3: onboarding.DENIED, 4: onboarding.NO_EMAIL, 5: onboarding.NO_EMAIL,
             6: onboarding.SHORT_PASSWORD, 7: None, 8: onboarding.LINKED, 9: onboarding.DENIED,
             10: onboarding.SHORT_PASSWORD},
        ),
        (
            "must_exist",
            {1: None, 2: onboarding.REPEATED, 3: onboarding.DENIED, 4: onboarding.NO_USER, 5: onboarding.NO_USER,
             6: onboarding.NO_USER, 7: onboarding.NO_USER, 8: onboarding.LINKED, 9: onboarding.DENIED,
             10: onboarding.NO_USER},
        ),
        ("create_always", {i: onboarding.DENIED if i in (3, 9) else None for i in range(1, 11)}),
    ],
)
def test_onboarding(spark, employees, users, mode, expected):
    accepted, rejected = onboarding.onboard(requests(spark), users, employees, mode)
    got = {r.request_id: None for r in accepted.collect()}
    got.update({r.request_id: r.reason for r in rejected.collect()})
    assert got == expected
    assert accepted.count() + rejected.count() == 10


def test_found_user_is_carried(spark, employees, users):
    accepted, _ = onboarding.onboard(requests(spark), users, employees)
    assert {r.request_id: r.user_id for r in accepted.collect()} == {1: 105, 7: None}


def test_codes_are_new_unique_and_repeatable(spark):
    asked = spark.range(500).withColumnRenamed("id", "request_id")
    used = spark.range(100_000, 400_000).selectExpr("concat('EMP', id) AS employee_code")
    coded, rejected = onboarding.assign_codes(asked, used)
    codes = {r.request_id: r.employee_code for r in coded.collect()}
    assert len(set(codes.values())) == 500 and rejected.count() == 0
    assert all(len(c) == 9 and 400_000 <= int(c[3:]) <= 999_999 for c in codes.values())
    again, _ = onboarding.assign_codes(asked.repartition(3), used)
    assert {r.request_id: r.employee_code for r in again.collect()} == codes


def test_requests_beyond_the_last_code_are_rejected(spark):
    used = spark.range(100_000, 999_998).selectExpr("concat('EMP', id) AS employee_code")
    coded, rejected = onboarding.assign_codes(spark.range(5).withColumnRenamed("id", "request_id"), used)
    assert sorted(r.employee_code for r in coded.collect()) == ["EMP999998", "EMP999999"]
    assert {r.reason for r in rejected.collect()} == {onboarding.NO_CODE} and rejected.count() == 3


def test_an_update_is_judged_on_the_new_row_as_well(spark, employees):
    moves = spark.createDataFrame(
        [(1, 3, 3, 103), (2, 3, 4, 103), (3, 4, 3, 103), (4, 3, 4, 102), (5, 3, None, 103)],
        "edit_id int, emp_id bigint, new_emp_id bigint, viewer_auth_id bigint",
    )
    judged = access.authorised(moves, employees, "module_progress", "update", "emp_id", "new_emp_id")
    assert {r.edit_id: r.outcome for r in judged.collect()} == {
        1: "applied", 2: "rejected", 3: "no_rows", 4: "no_rows", 5: "rejected"
    }
    staff = access.authorised(moves, employees, "employees", "update", "emp_id", "new_emp_id")
    assert {r.edit_id: r.outcome for r in staff.collect()}[4] == "applied"


def test_privileged_identities_follow_the_smallest_id(spark, employees):
    second = employees.where("id = 1").selectExpr("50 AS id", *[c for c in employees.columns if c != "id"])
    two = employees.unionByName(second.withColumn("auth_id", F.lit(103).cast("bigint")))
    assert [r.viewer_id for r in access.administrators(two).collect()] == [1]
    assert access.identities_with(two, ("sysAdmin",), max_rows=0).count() == 1
