"""Every registered query against its SQL, and rules every plan has to keep."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from inductra.plans.queries import QUERIES  # noqa: E402
from check_oracle import canonical, duckdb_rows, open_duckdb, spark_rows  # noqa: E402

SF = "/root/testdata/sf0.001"

# These write to disk while they are built and return a plain read of it.
WRITERS = {"progress_stream", "save_stream_employees", "save_stream_rows", "audit_stream", "audit_append", "snapshot_swap"}


@pytest.fixture(scope="module")
def connection():
    return open_duckdb(SF)


def test_names_agree():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, connection, name):
    got, want = spark_rows(queries()[name](spark, SF)), duckdb_rows(connection, oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_plan_has_no_cross_join_and_no_python(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert word not in plan


def test_entry_has_rows(spark):
    out = entry(spark)
    assert out.columns == ["employee_id", "done", "progress_pct", "completion_status"]
    assert out.count() > 0


@pytest.mark.parametrize(
    "name,key,descending",
    [("dashboard_roster", "id", None), ("employee_actions_v1", "id", False), ("roster_by_role", "id", False)],
)
def test_sorted_results(spark, connection, name, key, descending):
    got = [r[key] for r in queries()[name](spark, SF).collect()]
    want = [row[key] for _, row in duckdb_rows(connection, oracle_sql()[name]).iterrows()]
    assert got == (want if descending is None else sorted(want, reverse=descending))


@pytest.mark.parametrize("name", ["link_report", "link_report_raw", "link_report_linked", "audit_latest_20"])
def test_reports_keep_their_order(spark, connection, name):
    got = [r["id"] for r in queries()[name](spark, SF).collect()]
    assert got == list(duckdb_rows(connection, oracle_sql()[name])["id"])
