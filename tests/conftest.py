import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from inductra.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def employees(spark):
    """A small staff: one administrator, one manager, two employees, one unlinked."""
    columns = """id bigint, auth_id bigint, employee_code string, full_name string, phone string, age int,
        department string, position string, role string, start_date date, induction_date date,
        completion_status string, progress_pct int, created_at timestamp_ntz, updated_at timestamp_ntz"""
    text = """
        (1, 101, 'EMP100001', 'Ann', '041', 40, 'Office', 'Admin', 'sysAdmin', 'completed', 100),
        (2, 102, 'EMP100002', 'Bob', NULL, 35, 'Store', 'Manager', 'locationManager', 'pending', 0),
        (3, 103, 'EMP100003', 'Cyd', '043', 28, 'Store', 'Employee', 'employee', 'completed', 92),
        (4, 104, 'EMP100004', 'Dee', '', NULL, 'Store', 'Employee', 'employee', 'in_progress', 25),
        (5, NULL, 'EMP100005', NULL, '045', 51, 'Store', 'Employee', 'employee', 'pending', 0)"""
    rows = spark.sql(f"""
        SELECT id, auth_id, employee_code, full_name, phone, age, department, position, role,
               DATE '2024-01-01' AS start_date, DATE '2024-01-02' AS induction_date, completion_status,
               progress_pct, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS created_at,
               TIMESTAMP_NTZ '2024-01-01 00:00:00' AS updated_at
        FROM VALUES {text} AS t(id, auth_id, employee_code, full_name, phone, age, department, position, role,
                                completion_status, progress_pct)""")
    return rows.to(spark.createDataFrame([], columns).schema)


@pytest.fixture(scope="session")
def users(spark):
    return spark.sql("""
        SELECT CAST(id AS BIGINT) AS id, email,
               CASE WHEN confirmed THEN TIMESTAMP_NTZ '2024-02-01 00:00:00' END AS email_confirmed_at
        FROM VALUES (101, 'ann@example.com', true), (102, 'Bob@Example.com', false),
                    (103, 'cyd@example.com', true), (105, 'eve@example.com', true), (106, 'EVE@example.com', true)
                    AS t(id, email, confirmed)""")


@pytest.fixture
def run_dir(tmp_path):
    return str(tmp_path)
