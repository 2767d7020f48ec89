"""Induction-shaped projections of the star-schema test tables.

Every definition is SQL that both Spark and DuckDB accept. ``{name}`` stands for a
base table and ``{ntz}`` for the engine's zone-less timestamp type. No definition
drops rows to make a query cheaper.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FIXTURES: dict[str, str] = {
    "fx_catalogue": """
SELECT * FROM (VALUES
  (0,'generalRules'),(1,'ppe'),(2,'emergency'),(3,'manual'),(4,'forklift'),(5,'fire'),
  (6,'coldchain'),(7,'waste'),(8,'warehouse'),(9,'housekeeping'),(10,'incident'),(11,'rights')
) AS m(idx, module_id)""",
    "fx_submissions": """
SELECT e.event_id AS submission_id, e.user_id AS employee_id, m.module_id,
       e.props AS answers, e.event_type = 'purchase' AS completed, e.ts AS submitted_at
FROM {events} e JOIN fx_catalogue m ON m.idx = CAST((hour(e.ts) - hour(e.ts) % 2) / 2 AS INT)""",
    "fx_raw_submissions": """
SELECT submission_id, CASE WHEN submission_id % 31 = 0 THEN NULL ELSE employee_id END AS employee_id,
       CASE WHEN submission_id % 37 = 0 THEN NULL ELSE module_id END AS module_id,
       CASE WHEN submission_id % 41 = 0 THEN NULL ELSE answers END AS answers,
       CASE WHEN submission_id % 43 = 0 THEN NULL ELSE completed END AS completed,
       CASE WHEN submission_id % 47 = 0 THEN NULL ELSE submitted_at END AS submitted_at
FROM fx_submissions""",
    "fx_employees": """
SELECT c.c_custkey AS id,
       CASE WHEN c.c_acctbal >= 0 OR c.c_custkey % 50 = 0 THEN c.c_custkey + 100000 END AS auth_id,
       'EMP' || CAST(100000 + c.c_custkey AS STRING) AS employee_code,
       c.c_name AS full_name,
       CASE WHEN c.c_custkey % 7 = 0 THEN '' ELSE '04' || lpad(CAST(c.c_custkey AS STRING), 8, '0') END AS phone,
       CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE CAST(18 + c.c_custkey % 48 AS INT) END AS age,
       n.n_name AS work_location, c.c_mktsegment AS department, 'Employee' AS position,
       CASE WHEN c.c_custkey % 500 = 0 THEN 'sysAdmin'
            WHEN c.c_custkey % 50 = 0 THEN 'locationManager' ELSE 'employee' END AS role,
       CAST({ntz} '2023-01-01 00:00:00' + INTERVAL '1' MINUTE * c.c_custkey AS DATE) AS start_date,
       CAST({ntz} '2023-01-02 00:00:00' + INTERVAL '1' MINUTE * c.c_custkey AS DATE) AS induction_date,
       CASE WHEN c.c_custkey % 5 = 0 THEN 'completed'
            WHEN c.c_custkey % 5 = 1 THEN 'in_progress' ELSE 'pending' END AS completion_status,
       CASE WHEN c.c_custkey % 5 = 0
            THEN CAST({ntz} '2023-06-01 00:00:00' + INTERVAL '1' MINUTE * c.c_custkey AS DATE) END AS completion_date,
       CASE WHEN c.c_custkey % 5 = 0 THEN c.c_name END AS employee_signature,
       CASE WHEN c.c_custkey % 5 = 0 THEN n.n_name END AS supervisor_name,
       CASE WHEN c.c_custkey % 5 = 0 THEN n.n_name END AS supervisor_signature,
       CAST(CASE WHEN c.c_custkey % 5 = 0 THEN 100 WHEN c.c_custkey % 5 = 1 THEN 25 ELSE 0 END AS INT) AS progress_pct,
       {ntz} '2023-01-01 00:00:00' + INTERVAL '1' MINUTE * (c.c_custkey % 1000) AS created_at,
       {ntz} '2023-02-01 00:00:00' + INTERVAL '1' MINUTE * c.c_custkey AS updated_at
FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey""",
    "fx_users": """
SELECT CASE WHEN c.c_custkey % 11 = 0 THEN -1 - c.c_custkey ELSE c.c_custkey + 100000 END AS id,
       CASE WHEN c.c_custkey % 3 = 0 THEN upper(replace(c.c_name, '#', '.') || '@example.com')
            ELSE lower(replace(c.c_name, '#', '.') || '@example.com') END AS email,
       CASE WHEN c.c_nationkey % 5 = 0 THEN NULL
            ELSE {ntz} '2023-03-01 00:00:00' + INTERVAL '1' MINUTE * c.c_custkey END AS email_confirmed_at
FROM {customer} c""",
    "fx_code_lookups": """
SELECT o_orderkey AS lookup_id,
       CASE WHEN o_orderkey % 9 = 0 THEN 'EMP' || CAST(o_custkey AS STRING)
            WHEN o_orderkey % 2 = 0 THEN ' emp' || CAST(100000 + o_custkey AS STRING) || ' '
            ELSE 'EMP' || CAST(100000 + o_custkey AS STRING) END AS code
FROM {orders}""",
    "fx_links": """
SELECT c.c_custkey AS employee_id,
       CASE WHEN c.c_custkey % 13 = 0 THEN 'nobody' || CAST(c.c_custkey AS STRING) || '@example.com'
            WHEN c.c_custkey % 19 = 1
            THEN 'customer.' || lpad(CAST(c.c_custkey - c.c_custkey % 100 AS STRING), 9, '0') || '@example.com'
            ELSE ' ' || lower(replace(c.c_name, '#', '.')) || '@Example.com ' END AS email
FROM {customer} c""",
    "fx_profile_edits": """
SELECT o_orderkey AS edit_id, CASE WHEN o_orderkey % 401 = 0 THEN -1 ELSE o_custkey END AS emp_id,
       100000 + (o_orderkey % 4) * 50 AS actor_auth_id, o_orderdate AS edited_at,
       'Edited ' || CAST(o_orderkey % 3 AS STRING) AS full_name,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '04' || CAST(o_orderkey % 11 AS STRING) END AS phone,
       CAST(20 + o_orderkey % 40 AS INT) AS age,
       o_orderstatus AS position, o_orderpriority AS department
FROM {orders}""",
    "fx_actions": """
SELECT event_id AS action_id, user_id AS emp_id,
       CASE WHEN event_type = 'error' AND value > 200 THEN 'delete'
            WHEN event_type IN ('click', 'signup') THEN 'activate' ELSE 'inactive' END AS action,
       CASE WHEN value > 220 THEN 100500 WHEN value > 210 THEN -1 ELSE 100050 END AS actor_auth_id,
       ts AS acted_at
FROM {events}""",
    "fx_induction_events": """
SELECT event_id, user_id AS employee_id,
       CASE WHEN event_type = 'purchase' AND value > 200 THEN 'complete'
            WHEN event_type = 'signup' THEN 'start' ELSE 'open' END AS action, ts AS happened_at
FROM {events}""",
    "fx_viewers": """
SELECT id AS viewer_auth_id FROM fx_users""",
    "fx_onboarding": """
SELECT o_orderkey AS request_id, 100000 + (o_orderkey % 8) * 50 * (o_orderkey % 2) AS actor_auth_id,
       CASE WHEN o_orderkey % 10 = 0 THEN '   '
            WHEN o_orderkey % 10 < 6 THEN '  Customer.' || lpad(CAST(o_custkey AS STRING), 9, '0') || '@Example.com '
            ELSE 'new' || CAST(o_orderkey % 7000 AS STRING) || '@example.com' END AS email,
       CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE CAST(4 + o_orderkey % 9 AS INT) END AS password_length,
       'Starter ' || CAST(o_orderkey AS STRING) AS full_name, 'Warehouse' AS department,
       o_orderpriority AS position
FROM {orders}""",
    "fx_forms": """
SELECT s_suppkey AS form_id,
       CASE WHEN s_suppkey % 4 = 0 THEN 'sys_admin' WHEN s_suppkey % 4 = 1 THEN 'location_manager' ELSE 'employee' END AS actor_role,
       ' ' || s_name || ' ' AS full_name, ' ' || lower(replace(s_name, '#', '.')) || '@example.com' AS email,
       CASE WHEN s_suppkey % 3 = 0 THEN '   ' ELSE ' 04' || CAST(s_suppkey AS STRING) || ' ' END AS phone,
       ' Warehouse' AS department, 'Employee ' AS position,
       CASE WHEN s_suppkey % 5 = 0 THEN 'sys_admin' WHEN s_suppkey % 5 = 1 THEN 'location_manager' ELSE 'employee' END AS role
FROM {supplier}""",
    "fx_dirty_employees": """
SELECT id,
       CASE WHEN id % 109 = 1 THEN 'EMP' || CAST(100000 + id - 1 AS STRING) ELSE employee_code END AS employee_code,
       CASE WHEN id % 107 = 0 THEN NULL ELSE full_name END AS full_name,
       CASE WHEN id % 103 = 0 THEN 'owner' ELSE role END AS role,
       CAST(CASE WHEN id % 101 = 0 THEN 105 ELSE id % 101 END AS INT) AS progress_pct, auth_id
FROM fx_employees""",
    "fx_dirty_progress": """
SELECT event_id AS id, CASE WHEN event_type = 'error' AND value > 150 THEN -user_id - 1 ELSE user_id END AS employee_id,
       CASE WHEN value > 250 THEN 'unlisted' ELSE m.module_id END AS module_id
FROM {events} e JOIN fx_catalogue m ON m.idx = CAST((hour(e.ts) - hour(e.ts) % 2) / 2 AS INT)""",
    "fx_products": """
SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS name,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS category, p_brand AS description,
       CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'size ' || CAST(p_size AS STRING) END AS reject_note,
       CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE lower(p_type) END AS keywords
FROM {part}""",
    "fx_product_requests": """
SELECT DISTINCT l_orderkey AS request_id,
       CASE WHEN (l_orderkey + l_partkey) % 29 = 0 THEN -l_partkey ELSE l_partkey END AS product_id
FROM {lineitem}""",
    "fx_bodies": """
SELECT p_partkey AS request_id,
       CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS name_1,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS name_2,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS category,
       CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'size ' || CAST(p_size AS STRING) END AS reject_note,
       p_partkey % 4 = 1 AS has_list,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE lower(p_name) END AS single_name
FROM {part}""",
    "fx_attempts": """
SELECT CAST((event_id - event_id % 5) / 5 AS BIGINT) AS request_id,
       CASE WHEN event_id % 10 = 4 THEN 7 WHEN event_id % 10 = 8 THEN 12 ELSE event_id % 5 END AS attempt_rank,
       'model-' || CAST(event_id % 5 AS STRING) AS model,
       event_type <> 'error' AND event_id % 4 <> 0 AS ok,
       CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 4 = 0 THEN 429 ELSE 200 END AS status,
       CASE WHEN event_type = 'error' THEN NULL ELSE 'quota' END AS error_message,
       CASE event_id % 13
         WHEN 0 THEN '{"verdict":"pass","confidence":0.9,"explanation":"firm"}'
         WHEN 1 THEN '```json {"verdict":"fail","confidence":1.7,"explanation":"mould"} ```'
         WHEN 2 THEN '``` {"verdict":"uncertain","confidence":-1} ```'
         WHEN 3 THEN '{"verdict":"maybe","confidence":"0.9","explanation":"dim"}'
         WHEN 4 THEN '{"verdict":"PASS","confidence":0.4}'
         WHEN 5 THEN '{"verdict": "FAIL", "explanation": "cut off", "confid'
         WHEN 6 THEN '{"verdict":"pass"} trailing words'
         WHEN 7 THEN 'no idea'
         WHEN 8 THEN ''
         WHEN 9 THEN 'null'
         WHEN 10 THEN '[{"verdict":"pass"}]'
         WHEN 11 THEN '{"verdict":"fail","explanation":5}'
         ELSE '7' END AS reply_text
FROM {events}""",
    "fx_match_replies": """
SELECT request_id,
       CASE request_id % 12
         WHEN 0 THEN '{"match":true,"index":1,"confidence":0.9,"reason":"x"}'
         WHEN 1 THEN '{"match":true,"index":1,"confidence":0.35}'
         WHEN 2 THEN '{"match":true,"index":1,"confidence":0.34}'
         WHEN 3 THEN '{"match":false,"index":null,"confidence":0.8}'
         WHEN 4 THEN '{"match":true,"index":99,"confidence":0.8}'
         WHEN 5 THEN '{"match":true,"index":2,"confidence":0.7} trailing'
         WHEN 6 THEN '{"match":true,"index":1,"conf'
         WHEN 7 THEN '{"match":true,"index":0,"confidence":0.9}'
         WHEN 8 THEN 'null'
         WHEN 9 THEN '{"match":"yes","index":2,"confidence":1}'
         WHEN 10 THEN '```json{"match":1,"index":"1","confidence":0.9}```'
         ELSE 'sorry' END AS reply_text
FROM (SELECT DISTINCT l_orderkey AS request_id FROM {lineitem}) r""",
    "fx_check_requests": """
SELECT d.doc_id AS request_id,
       CASE WHEN d.doc_id % 7 = 0 THEN '  ' || chr(10) ELSE d.text END AS question,
       CASE WHEN d.doc_id % 9 = 0 THEN NULL WHEN d.doc_id % 6 = 0 THEN 'not a photo'
            ELSE 'data:image/png;base64,' || {b64_open}d.text{b64_close} END AS staff_photo,
       CASE WHEN d.doc_id % 8 = 0 THEN '' ELSE d.source END AS product_name,
       d.lang AS category, CAST(d.doc_id % 4 AS INT) AS n_candidates,
       d.doc_id % 10 = 3 AS text_only,
       CASE WHEN d.doc_id % 5 = 1 THEN 'http://missing.example.com/' || CAST(d.doc_id AS STRING) ELSE p.url END AS good_url,
       CASE WHEN d.doc_id % 4 = 1 THEN p.url WHEN d.doc_id % 4 = 2 THEN 'http://missing.example.com/r' END AS reject_url
FROM {documents} d LEFT JOIN {pages} p ON p.page_id = d.doc_id""",
    "fx_reference_photos": """
SELECT url, CASE WHEN page_id % 3 = 0 THEN 'image/png; charset=binary' WHEN page_id % 3 = 1 THEN NULL ELSE '' END AS content_type,
       {b64_open}html{b64_close} AS data
FROM (SELECT url, min(page_id) AS page_id, min(html) AS html FROM {pages} GROUP BY url) u""",
}

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _needed(names: tuple[str, ...]) -> list[str]:
    """The named fixtures and those they read, in definition order."""
    wanted, queue = set(), list(names)
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            queue += re.findall(r"\bfx_\w+", FIXTURES[name])
    return [name for name in FIXTURES if name in wanted]


def _render(sql: str, names: dict[str, str], ntz: str, b64: tuple[str, str]) -> str:
    for table, name in names.items():
        sql = sql.replace("{" + table + "}", name)
    return sql.replace("{ntz}", ntz).replace("{b64_open}", b64[0]).replace("{b64_close}", b64[1])


def duckdb_ctes(*names: str) -> str:
    """``name AS (...)`` items for a DuckDB ``WITH`` clause."""
    plain = {table: table for table in BASE_TABLES}
    b64 = ("to_base64(encode(", "))")
    return ",\n".join(f"{n} AS ({_render(FIXTURES[n], plain, 'TIMESTAMP', b64)})" for n in _needed(names))


_schemas: dict[tuple[str, str], StructType] = {}


def _base_view(spark: SparkSession, sf_dir: str, table: str) -> str:
    """A temporary view of a base table; its schema is inferred once per application."""
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    name = f"fx_base_{table}_{zlib.crc32(path.encode()):08x}"
    spark.read.schema(_schemas[key]).parquet(path).createOrReplaceTempView(name)
    return name


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named fixture over the parquet tables in ``sf_dir``."""
    needed = _needed((name,))
    text = "\n".join(FIXTURES[n] for n in needed)
    views = {t: _base_view(spark, sf_dir, t) for t in BASE_TABLES if "{" + t + "}" in text}
    # Spark breaks base64 text into lines; the fixture wants one line.
    b64 = ("replace(base64(encode(", ", 'UTF-8')), concat(chr(13), chr(10)), '')")
    ctes = ",\n".join(f"{n} AS ({_render(FIXTURES[n], views, 'TIMESTAMP_NTZ', b64)})" for n in needed)
    return spark.sql(f"WITH {ctes}\nSELECT * FROM {name}")
