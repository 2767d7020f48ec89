"""The registered queries as SQL for DuckDB, written without the operators' shortcuts."""

from __future__ import annotations

from inductra.operators import checks, onboarding
from inductra.sources.fixtures import duckdb_ctes

ORACLES: dict[str, str] = {}


def _quoted(text: str) -> str:
    """SQL literal; line breaks are spelled chr(10)."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def oracle(name: str, fixtures: str, body: str, ctes: str = "") -> None:
    """Register ``body`` with the named fixtures and further CTEs in front."""
    items = duckdb_ctes(*fixtures.split())
    ORACLES[name] = f"WITH {items}{',' if ctes else ''}\n{ctes}\n{body}"


# Progress ------------------------------------------------------------------------

PROGRESS = """
saved AS (
  SELECT *, row_number() OVER (PARTITION BY employee_id, module_id ORDER BY submitted_at DESC, submission_id DESC) AS rn
  FROM fx_submissions),
progress AS (
  SELECT l.employee_id, l.module_id, l.answers, l.completed, f.completed_at, f.created_at,
         l.submitted_at AS updated_at, l.submission_id AS last_submission_id
  FROM saved l JOIN (
    SELECT employee_id, module_id, min(submitted_at) FILTER (WHERE completed) AS completed_at,
           min(submitted_at) AS created_at
    FROM fx_submissions GROUP BY employee_id, module_id) f
  ON l.employee_id = f.employee_id AND l.module_id = f.module_id
  WHERE l.rn = 1)"""

for name in ("module_progress_upsert", "module_progress_merge", "progress_stream"):
    oracle(name, "fx_submissions", "SELECT * FROM progress", PROGRESS)

# The number of done modules after every submission, and its minimum per employee.
REPLAY = """
steps AS (
  SELECT employee_id, submitted_at, submission_id,
         CAST(completed AS INT) - CAST(coalesce(lag(completed) OVER (
           PARTITION BY employee_id, module_id ORDER BY submitted_at, submission_id), false) AS INT) AS change
  FROM fx_submissions),
runs AS (
  SELECT employee_id, submitted_at, sum(change) OVER (
           PARTITION BY employee_id ORDER BY submitted_at, submission_id ROWS UNBOUNDED PRECEDING) AS done
  FROM steps),
low AS (SELECT employee_id, min(done) AS done FROM runs GROUP BY employee_id)"""

for name, rule in {
    "progress_status": """
            WHEN p.done = 0 THEN 'pending' WHEN e.completion_status = 'completed' AND w.done > 0 THEN 'completed'
            ELSE 'in_progress'""",
    "progress_status_regressing": """
            WHEN p.done = 0 THEN 'pending' WHEN e.completion_status = 'completed' AND w.done = 12 THEN 'completed'
            ELSE 'in_progress'""",
}.items():
    oracle(name, "fx_submissions fx_employees", f"""
SELECT e.id AS employee_id, coalesce(p.done, 0) AS done, coalesce(p.pct, e.progress_pct) AS progress_pct,
       CASE WHEN p.done IS NULL THEN e.completion_status {rule} END AS completion_status
FROM fx_employees e LEFT JOIN (
  SELECT employee_id, count(*) FILTER (WHERE completed) AS done,
         CAST(round(CAST(count(*) FILTER (WHERE completed) AS DOUBLE) / 12 * 100) AS INT) AS pct
  FROM progress GROUP BY employee_id) p ON p.employee_id = e.id
LEFT JOIN low w ON w.employee_id = e.id""", PROGRESS + "," + REPLAY)

_UUID = ORACLES["progress_status"].replace("fx_submissions AS (", "fx_plain AS (", 1)
ORACLES["progress_status_uuid"] = _UUID.replace("saved AS (", """fx_submissions AS (
  SELECT * REPLACE (date_trunc('day', submitted_at) AS submitted_at,
    concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS submission_id)
  FROM (SELECT *, md5(CAST(submission_id AS VARCHAR)) AS h FROM fx_plain)),
saved AS (""", 1)
oracle("batch_violations", "fx_dirty_employees fx_employees fx_users", """
SELECT 'employee_code:unique' AS rule, employee_code AS row_key, count(*) AS n_rows FROM fx_dirty_employees
GROUP BY employee_code HAVING count(*) > 1 AND bool_or(id % 5 = 0)
UNION ALL
SELECT 'auth_id:unique', CAST(auth_id AS VARCHAR), count(*) FROM fx_dirty_employees WHERE auth_id IS NOT NULL
GROUP BY auth_id HAVING count(*) > 1 AND bool_or(id % 5 = 0)
UNION ALL
SELECT 'auth_id:foreign_key', CAST(auth_id AS VARCHAR), count(*) FROM fx_dirty_employees
WHERE id % 5 = 0 AND auth_id IS NOT NULL AND auth_id NOT IN (SELECT id FROM fx_users) GROUP BY auth_id""")

_LATE = "TIMESTAMP '2024-01-15 00:00:00'"
SAVE = f"""
staff AS (SELECT * FROM fx_employees WHERE id % 7 <> 3),
late AS (SELECT * FROM fx_raw_submissions WHERE submitted_at IS NULL OR submitted_at >= {_LATE}),
good AS (
  SELECT * FROM fx_raw_submissions
  WHERE employee_id IN (SELECT id FROM staff) AND module_id IS NOT NULL AND answers IS NOT NULL
    AND completed IS NOT NULL AND submitted_at IS NOT NULL),
"""
_OF_GOOD = (PROGRESS + "," + REPLAY).replace("fx_submissions", "good")
oracle("save_progress_rows", "fx_submissions fx_raw_submissions fx_employees", "SELECT * FROM progress", SAVE + _OF_GOOD)
oracle("save_progress_employees", "fx_submissions fx_raw_submissions fx_employees", f"""
SELECT e.id, coalesce(p.pct, e.progress_pct) AS progress_pct,
       CASE WHEN p.pct IS NULL THEN e.completion_status WHEN p.pct = 0 THEN 'pending'
            WHEN e.completion_status = 'completed' AND w.done > 0 THEN 'completed' ELSE 'in_progress' END AS completion_status
FROM staff e LEFT JOIN (
  SELECT employee_id, CAST(round(count(*) FILTER (WHERE completed) / 12.0 * 100) AS INT) AS pct
  FROM progress WHERE employee_id IN (SELECT employee_id FROM good WHERE submitted_at >= {_LATE})
  GROUP BY employee_id) p ON p.employee_id = e.id
LEFT JOIN (SELECT employee_id, min(done) AS done FROM runs WHERE submitted_at >= {_LATE} GROUP BY employee_id) w
ON w.employee_id = e.id""", SAVE + _OF_GOOD)
for streamed, batch in {"save_stream_rows": "save_progress_rows", "save_stream_employees": "save_progress_employees"}.items():
    ORACLES[streamed] = ORACLES[batch]
oracle("save_progress_rejects", "fx_submissions fx_raw_submissions fx_employees", """
SELECT * FROM (
  SELECT submission_id,
         CASE WHEN employee_id IS NULL THEN 'employee_id:not_null' WHEN module_id IS NULL THEN 'module_id:not_null'
              WHEN answers IS NULL THEN 'answers:not_null' WHEN completed IS NULL THEN 'completed:not_null'
              WHEN submitted_at IS NULL THEN 'submitted_at:not_null'
              WHEN employee_id NOT IN (SELECT id FROM staff) THEN 'employee_id:foreign_key' END AS reason
  FROM late) WHERE reason IS NOT NULL""", SAVE + _OF_GOOD)

oracle("progress_rejects", "fx_dirty_progress fx_employees", """
SELECT employee_id, module_id, max(id) AS last_submission_id, 'employee_id:foreign_key' AS reason
FROM fx_dirty_progress WHERE employee_id NOT IN (SELECT id FROM fx_employees) GROUP BY employee_id, module_id""")

oracle("submission_rejects", "fx_raw_submissions", """
SELECT submission_id,
       CASE WHEN employee_id IS NULL THEN 'employee_id' WHEN module_id IS NULL THEN 'module_id'
            WHEN answers IS NULL THEN 'answers' WHEN completed IS NULL THEN 'completed'
            ELSE 'submitted_at' END || ':not_null' AS reason
FROM fx_raw_submissions
WHERE employee_id IS NULL OR module_id IS NULL OR answers IS NULL OR completed IS NULL OR submitted_at IS NULL""")
oracle("progress_out_of_range", "fx_submissions fx_employees", """
SELECT employee_id, count(*) AS done, CAST(count(*) * 25 AS INT) AS progress_pct, 'progress_pct:range' AS reason
FROM progress WHERE completed AND employee_id IN (SELECT id FROM fx_employees)
GROUP BY employee_id HAVING count(*) > 4""", PROGRESS)

# Reads ---------------------------------------------------------------------------

oracle("email_by_code", "fx_code_lookups fx_employees fx_users", """
SELECT l.lookup_id, l.code, c.email
FROM fx_code_lookups l LEFT JOIN (
  SELECT upper(trim(e.employee_code)) AS code, u.email,
         row_number() OVER (PARTITION BY upper(trim(e.employee_code)) ORDER BY e.id) AS rn
  FROM fx_employees e JOIN fx_users u ON u.id = e.auth_id) c
ON c.code = upper(trim(l.code)) AND c.rn = 1""")

oracle("link_report", "fx_employees fx_users", """
SELECT e.id, e.employee_code, e.full_name, e.role, e.auth_id IS NOT NULL AS has_auth, u.email,
       u.email_confirmed_at IS NOT NULL AS is_confirmed
FROM fx_employees e LEFT JOIN fx_users u ON u.id = e.auth_id ORDER BY e.created_at DESC, e.id""")
oracle("link_report_raw", "fx_employees fx_users", """
SELECT e.id, e.employee_code, e.full_name, e.role, e.department, e.auth_id, u.email, u.email_confirmed_at
FROM fx_employees e LEFT JOIN fx_users u ON u.id = e.auth_id ORDER BY e.created_at DESC, e.id""")
oracle("link_report_linked", "fx_employees fx_users", """
SELECT e.id, e.employee_code, e.full_name, e.role, u.email, u.email_confirmed_at IS NOT NULL AS confirmed,
       e.auth_id IS NOT NULL AS linked
FROM fx_employees e LEFT JOIN fx_users u ON u.id = e.auth_id ORDER BY e.created_at, e.id""")

_ROSTER = """id, employee_code, full_name, phone, age, work_location, department, position, role,
       start_date, induction_date, completion_status, completion_date, progress_pct,
       employee_signature, supervisor_name, supervisor_signature"""
oracle("dashboard_roster", "fx_employees", f"SELECT {_ROSTER} FROM fx_employees ORDER BY created_at DESC, id")
oracle("dashboard_for_manager", "fx_employees", f"""
SELECT {_ROSTER} FROM fx_employees
WHERE EXISTS (SELECT 1 FROM fx_employees m WHERE m.auth_id = 100050 AND m.role IN ('locationManager', 'sysAdmin'))""")
oracle("dashboard_json", "fx_employees", f"""
SELECT r.id, CAST(to_json(r) AS VARCHAR) AS value FROM (SELECT {_ROSTER} FROM fx_employees) r""")
oracle("roster_by_role", "fx_employees", """
SELECT id, employee_code, full_name, role FROM fx_employees WHERE role = 'locationManager' ORDER BY id""")
oracle("rows_for_keys", "fx_employees fx_profile_edits", """
SELECT id, full_name, role FROM fx_employees WHERE id IN (SELECT emp_id FROM fx_profile_edits)""")
oracle("key_cardinality", "fx_employees fx_viewers", """
SELECT v.viewer_auth_id, count(e.id) AS n_rows,
       CASE count(e.id) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS cardinality
FROM (SELECT DISTINCT viewer_auth_id FROM fx_viewers) v LEFT JOIN fx_employees e ON e.auth_id = v.viewer_auth_id
GROUP BY v.viewer_auth_id""")

_RELINK = """
claims AS (
  SELECT l.employee_id, e.auth_id AS old_auth_id, u.user_id AS new_auth_id
  FROM fx_links l JOIN fx_employees e ON e.id = l.employee_id
  JOIN (SELECT lower(email) AS email, min(id) AS user_id FROM fx_users GROUP BY lower(email)) u
    ON u.email = lower(trim(l.email))
  WHERE e.auth_id IS NULL OR e.auth_id <> u.user_id),
judged AS (
  SELECT c.*, EXISTS (SELECT 1 FROM fx_employees h WHERE h.auth_id = c.new_auth_id) AS held,
         row_number() OVER (PARTITION BY c.new_auth_id ORDER BY c.employee_id) AS rn
  FROM claims c)"""
oracle("relink_changes", "fx_links fx_employees fx_users", """
SELECT employee_id, old_auth_id, new_auth_id FROM judged WHERE NOT held AND rn = 1""", _RELINK)
oracle("relink_rejects", "fx_links fx_employees fx_users", """
SELECT employee_id, old_auth_id, new_auth_id,
       CASE WHEN held THEN 'already_linked' ELSE 'claimed_in_batch' END AS reason
FROM judged WHERE held OR rn > 1""", _RELINK)

oracle("labels", "fx_employees", """
SELECT id, role,
       CASE role WHEN 'sysAdmin' THEN 'System Administrator' WHEN 'locationManager' THEN 'Location Manager'
                 ELSE 'Employee' END AS role_label,
       replace(completion_status, '_', ' ') AS status_label,
       coalesce(strftime(completion_date, '%-d %b %Y'), 'Not set') AS completion_label,
       strftime(created_at, '%-d %b %Y, %-I:%M ') || lower(strftime(created_at, '%p')) AS created_label,
       coalesce(strftime(start_date, '%d/%m/%Y'), '—') AS start_label,
       full_name || ' &lt;&amp;&#039;&quot;&gt;' AS name_html
FROM fx_employees""")

# Profile edits and audit ---------------------------------------------------------

EDITS = """
who AS (
  SELECT auth_id, min(id) AS viewer_id, arg_min(full_name, id) AS viewer_name, arg_min(role, id) AS viewer_role
  FROM fx_employees WHERE auth_id IS NOT NULL GROUP BY auth_id),
judged_edits AS (
  SELECT x.*, w.viewer_id, w.viewer_name, w.viewer_role,
         CASE WHEN coalesce(w.viewer_role, '') <> 'sysAdmin' THEN 'Permission denied'
              WHEN e.id IS NULL THEN 'emp_id:foreign_key' END AS reason
  FROM fx_profile_edits x LEFT JOIN who w ON w.auth_id = x.actor_auth_id LEFT JOIN fx_employees e ON e.id = x.emp_id),
good_edits AS (SELECT * FROM judged_edits WHERE reason IS NULL),
chain AS (
  SELECT g.*, lag(struct_pack(full_name := g.full_name, phone := g.phone, age := g.age, position := g.position,
                              department := g.department))
              OVER (PARTITION BY g.emp_id ORDER BY g.edited_at, g.edit_id) AS before
  FROM good_edits g),
audit AS (
  SELECT c.edit_id AS id, c.viewer_id AS actor_id, c.viewer_name AS actor_name, c.viewer_role AS actor_role,
         c.emp_id AS target_id, 'profile_edited' AS action, 'SysAdmin edited employee profile' AS detail,
         coalesce(c.before, struct_pack(full_name := e.full_name, phone := e.phone, age := e.age,
                                        position := e.position, department := e.department)) AS old,
         struct_pack(full_name := c.full_name, phone := c.phone, age := c.age, position := c.position,
                     department := c.department) AS new,
         c.edited_at AS created_at
  FROM chain c JOIN fx_employees e ON e.id = c.emp_id)"""

oracle("profile_edit_audit", "fx_profile_edits fx_employees", """
SELECT id, actor_id, actor_name, actor_role, target_id, action, detail,
       CAST(to_json(old) AS VARCHAR) AS old_value, CAST(to_json(new) AS VARCHAR) AS new_value, created_at
FROM audit""", EDITS)
oracle("profile_edit_rejects", "fx_profile_edits fx_employees", """
SELECT edit_id, emp_id, actor_auth_id AS viewer_auth_id, reason FROM judged_edits WHERE reason IS NOT NULL""", EDITS)
oracle("profile_current", "fx_profile_edits fx_employees", """
SELECT e.id,
       CASE WHEN g.edit_id IS NULL THEN e.full_name ELSE g.full_name END AS full_name,
       CASE WHEN g.edit_id IS NULL THEN e.phone ELSE g.phone END AS phone,
       CASE WHEN g.edit_id IS NULL THEN e.age ELSE g.age END AS age,
       CASE WHEN g.edit_id IS NULL THEN e.position ELSE g.position END AS position,
       CASE WHEN g.edit_id IS NULL THEN e.department ELSE g.department END AS department,
       e.start_date, e.induction_date,
       CASE WHEN g.edit_id IS NULL THEN e.updated_at ELSE TIMESTAMP '2026-01-01 00:00:00' END AS updated_at
FROM fx_employees e LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY emp_id ORDER BY edited_at DESC, edit_id DESC) AS rn FROM good_edits) g
ON g.emp_id = e.id AND g.rn = 1""", EDITS)
oracle("snapshot_merge", "fx_employees fx_onboarding", """
SELECT coalesce(e.id, c.id) AS id,
       CASE WHEN c.id IS NULL THEN e.full_name ELSE c.full_name END AS full_name, e.department,
       CASE WHEN e.id IS NULL THEN DATE '2030-01-01' ELSE e.start_date END AS start_date,
       CASE WHEN c.id IS NULL THEN e.updated_at ELSE TIMESTAMP '2026-01-01 00:00:00' END AS updated_at
FROM fx_employees e FULL JOIN (
  SELECT request_id AS id, min(full_name) AS full_name FROM fx_onboarding GROUP BY 1) c ON c.id = e.id""")
oracle("audit_field_changes", "fx_profile_edits fx_employees", "\nUNION ALL\n".join(
    f"""SELECT id, target_id, created_at, '{f}' AS field, CAST(old.{f} AS VARCHAR) AS old, CAST(new.{f} AS VARCHAR) AS new
FROM audit WHERE old.{f} IS DISTINCT FROM new.{f}"""
    for f in ("full_name", "phone", "age", "position", "department")), EDITS)
oracle("audit_latest_20", "fx_profile_edits fx_employees", """
SELECT id, actor_name, target_id, action, created_at FROM audit ORDER BY created_at DESC, id LIMIT 20""", EDITS)
oracle("audit_write", "fx_actions fx_employees", """
SELECT a.action_id, a.emp_id AS target_id, a.action, a.acted_at AS created_at,
       e.id AS actor_id, e.full_name AS actor_name, e.role AS actor_role
FROM fx_actions a LEFT JOIN fx_employees e ON e.auth_id = 100000 + a.emp_id * 7""")

oracle("audit_append", "fx_employees fx_actions", """
SELECT a.action_id AS id, e.id AS actor_id, a.emp_id AS target_id, a.action, CAST(a.acted_at AS DATE) AS audit_date
FROM fx_actions a LEFT JOIN fx_employees e ON e.auth_id = a.actor_auth_id""")
oracle("snapshot_swap", "fx_profile_edits fx_employees", """
SELECT e.id, CASE WHEN g.edit_id IS NULL THEN e.full_name ELSE g.full_name END AS full_name,
       CASE WHEN g.edit_id IS NULL THEN e.department ELSE g.department END AS department, e.start_date,
       CASE WHEN g.edit_id IS NULL THEN e.updated_at ELSE TIMESTAMP '2026-01-02 00:00:00' END AS updated_at
FROM fx_employees e LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY emp_id ORDER BY edited_at DESC, edit_id DESC) AS rn FROM good_edits) g
ON g.emp_id = e.id AND g.rn = 1""", EDITS)

# Deletion ------------------------------------------------------------------------

GONE = """
gone AS (
  SELECT emp_id AS id, min(acted_at) AS gone_at FROM fx_actions
  WHERE action = 'delete' AND actor_auth_id IN (SELECT auth_id FROM fx_employees WHERE role = 'sysAdmin')
  GROUP BY emp_id)"""
oracle("delete_employees", "fx_actions fx_employees", """
SELECT id, employee_code, full_name FROM fx_employees WHERE id NOT IN (SELECT id FROM gone)""", GONE)
oracle("delete_progress", "fx_actions fx_employees fx_submissions", """
SELECT employee_id, module_id, completed FROM progress WHERE employee_id NOT IN (SELECT id FROM gone)""",
       GONE + "," + PROGRESS)
oracle("delete_rejects", "fx_actions fx_employees", """
SELECT action_id AS deletion_id, emp_id, 'Permission denied' AS reason FROM fx_actions
WHERE action = 'delete' AND action_id NOT IN (
  SELECT a.action_id FROM fx_actions a JOIN fx_employees e ON e.auth_id = a.actor_auth_id WHERE e.role = 'sysAdmin')""")
oracle("delete_users", "fx_actions fx_employees fx_users", """
SELECT id, email FROM fx_users u
WHERE NOT EXISTS (SELECT 1 FROM fx_employees e JOIN gone g ON g.id = e.id WHERE e.auth_id = u.id)""", GONE)
oracle("delete_audit", "fx_actions fx_employees fx_profile_edits", """
SELECT CASE WHEN actor_id NOT IN (SELECT id FROM gone) THEN actor_id END AS actor_id, actor_name, actor_role,
       CASE WHEN target_id NOT IN (SELECT id FROM gone) THEN target_id END AS target_id, action, detail, created_at
FROM audit
UNION ALL
SELECT CASE WHEN a.id NOT IN (SELECT id FROM gone) THEN a.id END, a.full_name, a.role, NULL, 'employee_deleted',
       'Deleted: ' || e.full_name, g.gone_at
FROM gone g LEFT JOIN fx_employees e ON e.id = g.id
JOIN (
  SELECT d.emp_id, arg_min(m.id, row(d.acted_at, d.action_id)) AS by_id
  FROM fx_actions d JOIN fx_employees m ON m.auth_id = d.actor_auth_id
  WHERE d.action = 'delete' AND m.role = 'sysAdmin' GROUP BY d.emp_id) f ON f.emp_id = g.id
JOIN fx_employees a ON a.id = f.by_id""",
       GONE + "," + EDITS)

# Older portal --------------------------------------------------------------------

INDUCTION = """
induction AS (
  SELECT employee_id,
         CASE WHEN arg_max(action, row(happened_at, event_id)) = 'complete' THEN 'completed' ELSE 'in_progress' END AS status,
         CASE WHEN bool_or(action = 'complete') THEN 100 ELSE 10 END AS progress_percent,
         CASE WHEN arg_max(action, row(happened_at, event_id)) = 'complete' THEN 'Completed'
              ELSE 'Warehouse safety induction' END AS current_module,
         bool_or(action = 'complete') AS declaration_accepted,
         max(happened_at) FILTER (WHERE action = 'complete') AS declaration_accepted_at,
         max(happened_at) FILTER (WHERE action = 'complete') AS completed_at
  FROM fx_induction_events WHERE action IN ('start', 'complete') GROUP BY employee_id)"""
oracle("induction_v1", "fx_induction_events", "SELECT * FROM induction", INDUCTION)
oracle("induction_ensure", "fx_induction_events fx_employees", """
SELECT coalesce(i.employee_id, e.id) AS employee_id, coalesce(i.status, 'not_started') AS status,
       coalesce(i.progress_percent, 0) AS progress_percent
FROM fx_employees e FULL JOIN induction i ON i.employee_id = e.id""", INDUCTION)
oracle("employee_actions_v1", "fx_employees fx_actions", """
SELECT e.id, e.full_name,
       CASE e.role WHEN 'sysAdmin' THEN 'sys_admin' WHEN 'locationManager' THEN 'location_manager' ELSE e.role END AS role,
       CASE arg_max(a.action, row(a.acted_at, a.action_id)) WHEN 'activate' THEN 'active' WHEN 'inactive' THEN 'inactive'
            ELSE 'invited' END AS status
FROM fx_employees e LEFT JOIN (
  SELECT a.* FROM fx_actions a JOIN fx_employees m ON m.auth_id = a.actor_auth_id
  WHERE m.role = 'sysAdmin' OR (m.role = 'locationManager' AND a.action <> 'delete')) a ON a.emp_id = e.id
GROUP BY e.id, e.full_name, e.role
HAVING NOT coalesce(bool_or(a.action = 'delete'), false)""")
oracle("employee_actions_rejects", "fx_employees fx_actions", """
SELECT a.action_id, a.action, 'Permission denied' AS reason
FROM fx_actions a LEFT JOIN fx_employees m ON m.auth_id = a.actor_auth_id
WHERE NOT coalesce(m.role = 'sysAdmin' OR (m.role = 'locationManager' AND a.action <> 'delete'), false)""")
oracle("create_v1", "fx_forms", """
SELECT form_id, trim(full_name) AS full_name, trim(email) AS email, nullif(trim(phone), '') AS phone,
       trim(department) AS department, trim(position) AS position,
       CASE WHEN actor_role = 'sys_admin' THEN role ELSE 'employee' END AS role, 'invited' AS status
FROM fx_forms WHERE actor_role IN ('location_manager', 'sys_admin')""")
oracle("create_v1_rejects", "fx_forms", """
SELECT form_id, trim(email) AS email, 'Permission denied' AS reason
FROM fx_forms WHERE actor_role NOT IN ('location_manager', 'sys_admin')""")

# Access --------------------------------------------------------------------------

oracle("viewer_identity", "fx_viewers fx_employees", """
SELECT v.viewer_auth_id, e.id AS viewer_id, e.full_name AS viewer_name, e.role AS viewer_role
FROM fx_viewers v LEFT JOIN fx_employees e ON e.auth_id = v.viewer_auth_id""")

_SCOPED = """
SELECT v.viewer_auth_id, e.role AS viewer_role,
       CASE WHEN e.role IN ({roles}) THEN 'all' WHEN {own} THEN 'own' ELSE 'none' END AS scope,
       CASE WHEN e.role IN ({roles}) THEN (SELECT count(*) FROM {table})
            WHEN {own} THEN (SELECT count(*) FROM {table} t WHERE t.{owner} = e.id)
            ELSE 0 END AS visible_rows
FROM fx_viewers v LEFT JOIN fx_employees e ON e.auth_id = v.viewer_auth_id"""
_MANAGERS = "'locationManager', 'sysAdmin'"
oracle("visible_employees", "fx_viewers fx_employees",
       _SCOPED.format(roles=_MANAGERS, own="e.id IS NOT NULL", table="fx_employees", owner="id"))
oracle("visible_progress", "fx_viewers fx_employees fx_submissions",
       _SCOPED.format(roles=_MANAGERS, own="e.id IS NOT NULL", table="progress", owner="employee_id"), PROGRESS)
oracle("visible_audit", "fx_viewers fx_employees fx_profile_edits",
       _SCOPED.format(roles="'sysAdmin'", own="false", table="audit", owner="target_id"), EDITS)
oracle("own_progress_rows", "fx_viewers fx_employees fx_submissions", f"""
SELECT p.employee_id, p.module_id, p.completed, v.viewer_auth_id
FROM fx_viewers v JOIN fx_employees e ON e.auth_id = v.viewer_auth_id AND e.role NOT IN ({_MANAGERS})
JOIN progress p ON p.employee_id = e.id""", PROGRESS)
oracle("progress_seen_by_manager", "fx_employees fx_submissions", f"""
SELECT p.employee_id, p.module_id, p.completed FROM progress p
WHERE EXISTS (SELECT 1 FROM fx_employees e
              WHERE e.auth_id = 100050 AND (e.role IN ({_MANAGERS}) OR e.id = p.employee_id))""", PROGRESS)
oracle("write_authorised", "fx_profile_edits fx_employees", f"""
SELECT x.edit_id, e.role AS viewer_role, coalesce(e.role IN ({_MANAGERS}) OR e.id = x.emp_id, false) AS allowed,
       CASE WHEN e.role IN ({_MANAGERS}) OR e.id = x.emp_id THEN 'applied' ELSE 'no_rows' END AS outcome
FROM fx_profile_edits x LEFT JOIN fx_employees e
ON e.auth_id = CASE WHEN x.edit_id % 2 = 0 THEN x.actor_auth_id ELSE x.emp_id + 100000 END""")

oracle("write_moves", "fx_profile_edits fx_employees", """
SELECT edit_id, coalesce(old_row AND new_row, false) AS allowed,
       CASE WHEN old_row AND new_row THEN 'applied' WHEN old_row THEN 'rejected' ELSE 'no_rows' END AS outcome
FROM (
  SELECT x.edit_id, e.id = x.emp_id AS old_row, e.id = x.emp_id + x.edit_id % 3 - 1 AS new_row
  FROM fx_profile_edits x LEFT JOIN fx_employees e ON e.auth_id = 100000 + x.emp_id - x.edit_id % 2)""")

_POLICIES = {
    "employees:insert": "role = 'sysAdmin'",
    "employees:update": f"role IN ({_MANAGERS}) OR id = emp_id",
    "employees:delete": "role = 'sysAdmin'",
    "module_progress:insert": "id = emp_id",
    "module_progress:update": "id = emp_id",
    "module_progress:delete": "id = emp_id",
    "audit_logs:insert": "viewer IS NOT NULL",
    "audit_logs:update": "false",
    "audit_logs:delete": "false",
}
oracle("write_policies", "fx_profile_edits fx_employees", "\nUNION ALL\n".join(
    f"""SELECT '{policy}' AS policy, edit_id, coalesce({rule}, false) AS allowed,
       CASE WHEN {rule} THEN 'applied' ELSE '{"rejected" if policy.endswith("insert") else "no_rows"}' END AS outcome
FROM callers""" for policy, rule in _POLICIES.items()), """
callers AS (
  SELECT x.edit_id, x.emp_id, 100000 + x.emp_id - x.edit_id % 2 AS viewer, e.id, e.role
  FROM fx_profile_edits x LEFT JOIN fx_employees e ON e.auth_id = 100000 + x.emp_id - x.edit_id % 2)""")

# Quality rules -------------------------------------------------------------------

oracle("rule_violations", "fx_dirty_employees fx_dirty_progress fx_users", """
SELECT 'full_name:not_null' AS rule, CAST(id AS VARCHAR) AS row_key, 1 AS n_rows FROM fx_dirty_employees WHERE full_name IS NULL
UNION ALL SELECT 'progress_pct:range', CAST(id AS VARCHAR), 1 FROM fx_dirty_employees WHERE progress_pct < 0 OR progress_pct > 100
UNION ALL SELECT 'role:domain', CAST(id AS VARCHAR), 1 FROM fx_dirty_employees WHERE role NOT IN ('employee', 'locationManager', 'sysAdmin')
UNION ALL SELECT 'employee_code:unique', employee_code, count(*) FROM fx_dirty_employees WHERE employee_code IS NOT NULL
  GROUP BY employee_code HAVING count(*) > 1
UNION ALL SELECT 'employee_id+module_id:unique', employee_id || '|' || module_id, count(*) FROM fx_dirty_progress
  GROUP BY employee_id, module_id HAVING count(*) > 1
UNION ALL SELECT 'auth_id:foreign_key', CAST(auth_id AS VARCHAR), count(*) FROM fx_dirty_employees
  WHERE auth_id NOT IN (SELECT id FROM fx_users) GROUP BY auth_id
UNION ALL SELECT 'employee_id:foreign_key', CAST(employee_id AS VARCHAR), count(*) FROM fx_dirty_progress
  WHERE employee_id NOT IN (SELECT id FROM fx_dirty_employees) GROUP BY employee_id
UNION ALL SELECT 'module_id:catalogue', module_id, count(*) FROM fx_dirty_progress
  WHERE module_id NOT IN (SELECT module_id FROM fx_catalogue) GROUP BY module_id""")

# Onboarding ----------------------------------------------------------------------


def _onboarding(mode: str) -> str:
    linked = f"WHEN EXISTS (SELECT 1 FROM fx_employees h WHERE h.auth_id = u.user_id) THEN {_quoted(onboarding.LINKED)}"
    checks_before = linked_after = missing = ""
    if mode == "find_or_create":
        checks_before = f"""WHEN trim(coalesce(r.email, '')) = '' THEN {_quoted(onboarding.NO_EMAIL)}
              WHEN coalesce(r.password_length, 0) < 6 THEN {_quoted(onboarding.SHORT_PASSWORD)}"""
    if mode == "must_exist":
        missing = f"WHEN u.user_id IS NULL THEN {_quoted(onboarding.NO_USER)}"
    if mode != "create_always":
        linked_after = missing + " " + linked
    user = "NULL" if mode == "create_always" else "user_id"
    repeat = "false" if mode == "create_always" else "rn > 1"
    return f"""
looked AS (
  SELECT r.*, lower(trim(r.email)) AS email_key, u.user_id,
         CASE WHEN coalesce(a.role, '') <> 'sysAdmin' THEN 'Permission denied' {checks_before} END AS early,
         CASE {linked_after or "WHEN false THEN ''"} END AS late
  FROM fx_onboarding r LEFT JOIN fx_employees a ON a.auth_id = r.actor_auth_id
  LEFT JOIN (SELECT lower(email) AS email, min(id) AS user_id FROM fx_users GROUP BY 1) u
    ON u.email = lower(trim(r.email))),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY email_key, early IS NULL ORDER BY request_id) AS rn FROM looked),
decided AS (
  SELECT request_id, email_key, full_name, department, position,
         -- the user is looked up only for e-mails some request may use
         CAST(CASE WHEN bool_or(early IS NULL) OVER (PARTITION BY email_key) THEN {user} END AS BIGINT) AS user_id,
         coalesce(early, late, CASE WHEN {repeat} THEN {_quoted(onboarding.REPEATED)} END) AS reason
  FROM ranked)"""


for name, mode in {
    "onboarding_decisions": "find_or_create",
    "onboarding_must_exist": "must_exist",
    "onboarding_create_always": "create_always",
}.items():
    oracle(name, "fx_onboarding fx_employees fx_users",
           "SELECT request_id, email_key, user_id, reason FROM decided", _onboarding(mode))

oracle("onboarding_new_rows", "fx_onboarding fx_employees fx_users", """
SELECT user_id AS auth_id, request_id, full_name, department, position, 'employee' AS role,
       'Main site' AS work_location, 'pending' AS completion_status, 0 AS progress_pct,
       DATE '2026-01-01' AS start_date, TIMESTAMP '2026-01-01 00:00:00' AS created_at
FROM decided WHERE reason IS NULL""", _onboarding("find_or_create"))
oracle("new_codes", "fx_onboarding fx_employees fx_users", f"""
SELECT q.request_id, c.employee_code
FROM (SELECT request_id, row_number() OVER (ORDER BY request_id) AS place FROM decided WHERE reason IS NULL) q
JOIN (SELECT employee_code, row_number() OVER (ORDER BY step) AS place
      FROM (SELECT range AS step, 'EMP' || CAST(100000 + (range * {onboarding.CODE_STRIDE}) % 900000 AS VARCHAR) AS employee_code
            FROM range(900000))
      WHERE employee_code NOT IN (SELECT employee_code FROM fx_employees)) c
ON c.place = q.place""", _onboarding("find_or_create"))
# The stride of the walk over codes is spelled out here, not taken from the operator.
_CREATED = _onboarding("find_or_create") + """,
codes AS (
  SELECT employee_code, row_number() OVER (ORDER BY step) AS place
  FROM (SELECT range AS step, 'EMP' || CAST(100000 + (range * 611953) % 900000 AS VARCHAR) AS employee_code FROM range(900000))
  WHERE employee_code NOT IN (SELECT employee_code FROM fx_employees)),
accepted AS (
  SELECT *, row_number() OVER (ORDER BY request_id) AS place,
         row_number() OVER (PARTITION BY user_id IS NULL ORDER BY request_id) AS new_place
  FROM decided WHERE reason IS NULL),
created AS (
  SELECT a.*, c.employee_code, (SELECT max(id) FROM fx_employees) + a.place AS id,
         coalesce(a.user_id, (SELECT max(id) FROM fx_users) + a.new_place) AS auth_id
  FROM accepted a JOIN codes c ON c.place = a.place)"""
oracle("onboarding_users", "fx_onboarding fx_employees fx_users", """
SELECT auth_id AS id, email_key AS email, TIMESTAMP '2026-01-01 00:00:00' AS email_confirmed_at
FROM created WHERE user_id IS NULL""", _CREATED)
oracle("onboarding_employees", "fx_onboarding fx_employees fx_users", """
SELECT id, request_id, auth_id, employee_code, full_name, department, position, 'employee' AS role,
       'Main site' AS work_location, 'pending' AS completion_status, 0 AS progress_pct,
       DATE '2026-01-01' AS start_date, TIMESTAMP '2026-01-01 00:00:00' AS created_at
FROM created""", _CREATED)
oracle("onboarding_rejects", "fx_onboarding fx_employees fx_users",
       "SELECT request_id, reason FROM decided WHERE reason IS NOT NULL", _onboarding("find_or_create"))
oracle("sequential_ids", "fx_employees", """
SELECT id, created_at, 'STF' || CASE WHEN n > 999999 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 6, '0') END AS employee_id
FROM (SELECT id, created_at, row_number() OVER (ORDER BY created_at, id) AS n FROM fx_employees)""")

# Product quality checks ----------------------------------------------------------

_DATA_URL = r"'^data:(image/[a-zA-Z0-9.+-]+);base64,(.+)$'"
_UNREADABLE = f"NOT regexp_matches(staff_photo, {_DATA_URL})"
oracle("check_request_decisions", "fx_check_requests", f"""
SELECT request_id, 'question' AS kind,
       CASE WHEN regexp_replace(question, '^\\s+|\\s+$', '', 'g') = '' THEN {_quoted(checks.NO_QUESTION)} END AS reason
FROM fx_check_requests
UNION ALL
SELECT request_id, 'photo',
       CASE WHEN coalesce(staff_photo, '') = '' THEN {_quoted(checks.NO_STAFF_PHOTO)}
            WHEN coalesce(product_name, '') = '' THEN {_quoted(checks.NO_PRODUCT)}
            WHEN {_UNREADABLE} THEN {_quoted(checks.BAD_STAFF_PHOTO)} END
FROM fx_check_requests
UNION ALL
SELECT request_id, 'identify',
       CASE WHEN coalesce(staff_photo, '') = '' THEN {_quoted(checks.NO_PHOTO)}
            WHEN n_candidates = 0 THEN {_quoted(checks.NO_CANDIDATES)}
            WHEN {_UNREADABLE} THEN {_quoted(checks.BAD_PHOTO)} END
FROM fx_check_requests""")
oracle("photo_decode", "fx_check_requests", f"""
SELECT request_id, regexp_extract(staff_photo, {_DATA_URL}, 1) AS mime_type,
       octet_length(from_base64(regexp_extract(staff_photo, {_DATA_URL}, 2))) AS n_bytes,
       md5(from_base64(regexp_extract(staff_photo, {_DATA_URL}, 2))) AS md5
FROM fx_check_requests WHERE regexp_matches(staff_photo, {_DATA_URL})""")

BODIES = """
bodies AS (
  SELECT request_id, has_list,
         struct_pack(name := name_1, category := category, description := 'clean', reject_note := reject_note,
                     keywords := single_name) AS p1,
         struct_pack(name := name_2, category := CAST(NULL AS VARCHAR), description := '',
                     reject_note := CAST(NULL AS VARCHAR), keywords := CAST(NULL AS VARCHAR)) AS p2,
         struct_pack(name := single_name, category := category, description := name_2, reject_note := 'soft',
                     keywords := '') AS p3
  FROM fx_bodies)"""


def _facts(p: str, accept: str, reject: str) -> str:
    return f"""'Category: ' || coalesce(nullif({p}.category, ''), 'unknown') || chr(10) ||
    '{accept}' || coalesce(nullif({p}.description, ''), 'not recorded') || chr(10) ||
    '{reject}' || coalesce(nullif({p}.reject_note, ''), 'not recorded') || chr(10) ||
    'Keywords: ' || coalesce(nullif({p}.keywords, ''), 'none')"""


_BLOCK_FACTS = "chr(10) || {facts}"
oracle("product_context", "fx_bodies", f"""
SELECT b.request_id,
       coalesce(string_agg(
         CASE WHEN b.n > 1 THEN '--- Product ' || b.i || ': ' || b.p.name || ' ---' ELSE '--- Product: ' || b.p.name || ' ---' END
         || chr(10) || {_facts("b.p", "Accept / good quality: ", "Reject / fails standard: ")},
         chr(10) || chr(10) ORDER BY b.i) FILTER (WHERE b.p IS NOT NULL),
         {_quoted(checks.NO_PRODUCT_BLOCK.format(house="site"))}) AS context
FROM (
  SELECT r.request_id, l.p, row_number() OVER (PARTITION BY r.request_id ORDER BY l.pos) AS i,
         count(*) OVER (PARTITION BY r.request_id) AS n
  FROM bodies r LEFT JOIN (
    SELECT request_id, 1 AS pos, p1 AS p FROM bodies WHERE has_list AND p1.name <> ''
    UNION ALL SELECT request_id, 2, p2 FROM bodies WHERE has_list AND p2.name <> ''
    UNION ALL SELECT request_id, 3, p3 FROM bodies WHERE p3.name <> '') l ON l.request_id = r.request_id) b
GROUP BY b.request_id""", BODIES)
ORACLES["product_context_json"] = ORACLES["product_context"]
oracle("product_blocks", "fx_product_requests fx_products", f"""
SELECT request_id, position, product_id,
       CASE WHEN n > 1 THEN '--- Product ' || position || ': ' || p.name || ' ---' ELSE '--- Product: ' || p.name || ' ---' END
       || chr(10) || {_facts("p", "Accept / good quality: ", "Reject / fails standard: ")} AS block
FROM (
  SELECT r.request_id, r.product_id, p, row_number() OVER (PARTITION BY r.request_id ORDER BY r.product_id) AS position,
         count(*) OVER (PARTITION BY r.request_id) AS n
  FROM fx_product_requests r JOIN fx_products p ON p.id = r.product_id AND p.name <> '')""")

_LINE = "{n} || '. ' || coalesce({p}.name, '') || CASE WHEN coalesce({p}.category, '') <> '' THEN ' (' || {p}.category || ')' ELSE '' END"
oracle("candidate_list", "fx_bodies", f"""
SELECT request_id,
       CASE WHEN has_list THEN {_LINE.format(n="1", p="p1")} || chr(10) || {_LINE.format(n="2", p="p2")} || chr(10) ||
       {_LINE.format(n="3", p="p3")} END AS candidate_text,
       CASE WHEN NOT has_list THEN 'No candidate products provided.' END AS reason
FROM bodies""", BODIES)

CANDIDATES = f"""
candidates AS (
  SELECT r.request_id, r.position, r.product_id, p.name, {_LINE.format(n="r.position", p="p")} AS line
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY product_id) AS position FROM fx_product_requests
        WHERE product_id IN (SELECT id FROM fx_products)) r
  JOIN fx_products p ON p.id = r.product_id)"""
oracle("candidate_rejects", "fx_product_requests fx_products", """
SELECT request_id, product_id, 'product_id:foreign_key' AS reason
FROM fx_product_requests WHERE product_id NOT IN (SELECT id FROM fx_products)""")
oracle("candidate_lines", "fx_product_requests fx_products",
       "SELECT request_id, position, product_id, line FROM candidates", CANDIDATES)

_INFO = "'Product: ' || q.product_name || chr(10) || " + _facts("q", "Accept criteria (GOOD): ", "Reject criteria (FAILS standard): ")
PROMPTS = f"""
valid AS (
  SELECT r.*, {{description}} AS description, CAST(NULL AS VARCHAR) AS reject_note, '' AS keywords,
         regexp_extract(staff_photo, {_DATA_URL}, 1) AS mime, regexp_extract(staff_photo, {_DATA_URL}, 2) AS payload,
         NOT coalesce(text_only, false) AND coalesce(good_url, '') <> '' AS versus
  FROM fx_check_requests r
  WHERE regexp_matches(staff_photo, {_DATA_URL}) AND coalesce(product_name, '') <> ''),
photos AS (
  SELECT url, split_part(coalesce(nullif(content_type, ''), 'image/jpeg'), ';', 1) AS mime_type, data FROM fx_reference_photos),
joined AS (
  SELECT q.*, g.url AS g_url, g.mime_type AS g_mime, g.data AS g_data, x.url AS x_url, x.mime_type AS x_mime, x.data AS x_data
  FROM valid q LEFT JOIN photos g ON q.versus AND g.url = q.good_url
  LEFT JOIN photos x ON q.versus AND x.url = q.reject_url)"""
_ROWS = [
    ("NOT versus", "0", f"""{_quoted(checks.PHOTO_ALONE.format(house="site"))} || {_INFO}
      || {_quoted(checks.PHOTO_ALONE_TASK)}""", "NULL", "NULL"),
    ("NOT versus", "1", "NULL", "mime", "payload"),
    ("versus", "0", f"""{_quoted(checks.PHOTO_VERSUS.format(house="site"))} || q.product_name || '.'
      || chr(10) || chr(10) || {_INFO} || {_quoted(checks.PHOTO_VERSUS_TASK)}""", "NULL", "NULL"),
    ("versus", "1", "'Example of an acceptable batch of ' || q.product_name || ':'", "NULL", "NULL"),
    ("versus", "2", "NULL", "g_mime", "g_data"),
    ("versus AND x_url IS NOT NULL", "3", "'Example of a rejected batch of ' || q.product_name || ':'", "NULL", "NULL"),
    ("versus AND x_url IS NOT NULL", "4", "NULL", "x_mime", "x_data"),
    ("versus", "CASE WHEN x_url IS NULL THEN 3 ELSE 5 END", _quoted(checks.STAFF_CAPTION), "NULL", "NULL"),
    ("versus", "CASE WHEN x_url IS NULL THEN 4 ELSE 6 END", "NULL", "mime", "payload"),
]
oracle("photo_prompt_parts", "fx_check_requests fx_reference_photos", "\nUNION ALL\n".join(
    f"SELECT request_id, {no} AS part_no, {text} AS text, {mime} AS mime_type, {data} AS data FROM joined q "
    f"WHERE NOT (versus AND g_url IS NULL) AND {when}"
    for when, no, text, mime, data in _ROWS), PROMPTS.format(description="'clean'"))
oracle("photo_prompt_rejects", "fx_check_requests fx_reference_photos", f"""
SELECT request_id, {_quoted(checks.NO_REFERENCE)} AS reason FROM joined WHERE versus AND g_url IS NULL""",
       PROMPTS.format(description="'clean'"))

oracle("reply_texts", "fx_attempts", "SELECT request_id, attempt_rank, trim(reply_text) AS reply_text FROM fx_attempts")
ORACLES["attempt_problems"] = """
SELECT l_orderkey AS request_id, CAST(l_linenumber - 1 AS BIGINT) AS attempt_rank, count(*) AS n_rows,
       CASE WHEN l_linenumber > 5 THEN 'attempt_rank:range' ELSE 'request_id+attempt_rank:unique' END AS reason
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 OR l_linenumber > 5"""

_FENCELESS = r"""trim(regexp_replace(regexp_replace(regexp_replace(trim(reply_text), '^```json\s*', '', 'i'), '^```\s*', ''), '```\s*$', ''))"""
_NUMERIC = "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')"
VERDICTS = f"""
raws AS (SELECT *, {_FENCELESS} AS raw FROM fx_attempts),
kinds AS (SELECT *, CASE WHEN json_valid(raw) THEN json_type(raw) END AS kind FROM raws),
fields AS (
  SELECT *, CASE WHEN kind = 'OBJECT' AND json_type(raw, '$.verdict') = 'VARCHAR' THEN json_extract_string(raw, '$.verdict') END AS v,
         CASE WHEN kind = 'OBJECT' AND json_type(raw, '$.confidence') IN {_NUMERIC} THEN CAST(json_extract(raw, '$.confidence') AS DOUBLE) END AS c,
         CASE WHEN kind = 'OBJECT' AND json_type(raw, '$.explanation') = 'VARCHAR' THEN json_extract_string(raw, '$.explanation') END AS x,
         lower(regexp_extract(raw, '(?i)"verdict"\\s*:\\s*"(pass|fail|uncertain)"', 1)) AS found,
         regexp_extract(raw, '"explanation"\\s*:\\s*"([^"]+)"', 1) AS found_x
  FROM kinds),
verdicts AS (
  SELECT *, CASE WHEN kind = 'NULL' THEN 'failed' WHEN kind IS NOT NULL THEN 'parsed' WHEN found <> '' THEN 'salvaged' ELSE 'failed' END AS reply_status
  FROM fields),
shown AS (
  SELECT request_id, attempt_rank, model, ok, status, error_message, reply_text, raw, reply_status,
         CASE reply_status WHEN 'parsed' THEN CASE WHEN v IN ('pass', 'fail', 'uncertain') THEN v ELSE 'uncertain' END
                           WHEN 'salvaged' THEN found END AS verdict,
         CASE WHEN c IS NOT NULL THEN greatest(0.0, least(1.0, c)) END AS confidence,
         CASE reply_status WHEN 'parsed' THEN coalesce(x, '') WHEN 'salvaged' THEN found_x END AS explanation
  FROM verdicts)"""
oracle("verdicts", "fx_attempts", """
SELECT request_id, attempt_rank, reply_status, verdict, confidence, explanation FROM shown""", VERDICTS)
oracle("first_success", "fx_attempts", """
SELECT g.request_id, g.n_attempts, s.attempt_rank IS NOT NULL AS succeeded, s.attempt_rank, s.model, s.verdict,
       s.confidence, s.explanation,
       CASE WHEN s.attempt_rank IS NULL THEN 'AI service unavailable. Details: ' || array_to_string(g.errors[1:3], ' | ') END AS error
FROM (
  SELECT request_id, count(*) AS n_attempts,
         list(model || ': ' || CASE WHEN NOT ok AND error_message IS NULL THEN CAST(status AS VARCHAR)
                                    WHEN NOT ok THEN status || ' ' || error_message
                                    WHEN raw = 'null' THEN 'reply is null'
                                    ELSE 'JSON parse failed — ' || substring(raw, 1, 80) END
              ORDER BY attempt_rank) FILTER (WHERE NOT ok OR reply_status = 'failed') AS errors
  FROM shown GROUP BY request_id) g
LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY attempt_rank) AS rn
  FROM shown WHERE ok AND reply_status <> 'failed') s ON s.request_id = g.request_id AND s.rn = 1""", VERDICTS)
oracle("first_answer", "fx_attempts", """
SELECT g.request_id, g.n_attempts, s.attempt_rank IS NOT NULL AS succeeded, s.attempt_rank, s.model,
       trim(s.reply_text) AS answer,
       CASE WHEN s.attempt_rank IS NULL THEN 'AI service unavailable. Tried: ' || array_to_string(g.errors, ' | ') END AS error
FROM (
  SELECT request_id, count(*) AS n_attempts,
         list(model || ': ' || CASE WHEN NOT ok THEN status || ' ' || coalesce(error_message, '') ELSE 'empty response' END
              ORDER BY attempt_rank) FILTER (WHERE NOT ok OR trim(reply_text) = '') AS errors
  FROM fx_attempts GROUP BY request_id) g
LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY attempt_rank) AS rn
  FROM fx_attempts WHERE ok AND trim(reply_text) <> '') s ON s.request_id = g.request_id AND s.rn = 1""")
oracle("product_matches", "fx_match_replies fx_product_requests fx_products", f"""
SELECT r.request_id,
       CASE WHEN r.kind = 'NULL' THEN 'error' WHEN r.kind IS NOT NULL THEN 'parsed' WHEN c.position IS NOT NULL THEN 'salvaged' ELSE 'failed' END AS match_status,
       c.product_id, c.name AS product_name,
       CASE WHEN r.kind = 'NULL' THEN NULL WHEN r.kind IS NOT NULL THEN r.conf WHEN c.position IS NOT NULL THEN r.said END AS match_confidence
FROM (
  SELECT *, CASE WHEN kind = 'OBJECT' THEN CASE WHEN truthy AND conf >= 0.35 THEN idx END WHEN kind IS NULL THEN found END AS place
  FROM (
    SELECT *, coalesce(CASE WHEN json_type(raw2, '$.confidence') IN {_NUMERIC} THEN CAST(json_extract(raw2, '$.confidence') AS DOUBLE) END, 0) AS conf,
           CASE WHEN json_type(raw2, '$.index') IN {_NUMERIC} THEN CAST(json_extract(raw2, '$.index') AS DOUBLE) END AS idx,
           CASE json_type(raw2, '$.match') WHEN 'BOOLEAN' THEN CAST(json_extract(raw2, '$.match') AS BOOLEAN)
                WHEN 'VARCHAR' THEN json_extract_string(raw2, '$.match') <> '' WHEN 'NULL' THEN false
                WHEN 'UBIGINT' THEN CAST(json_extract(raw2, '$.match') AS DOUBLE) <> 0
                WHEN 'BIGINT' THEN CAST(json_extract(raw2, '$.match') AS DOUBLE) <> 0
                WHEN 'DOUBLE' THEN CAST(json_extract(raw2, '$.match') AS DOUBLE) <> 0
                ELSE json_type(raw2, '$.match') IS NOT NULL END AS truthy,
           try_cast(regexp_extract(raw, '"index"\\s*:\\s*(\\d+)', 1) AS DOUBLE) AS found,
           coalesce(try_cast(nullif(regexp_extract(raw, '"confidence"\\s*:\\s*([\\d.]+)', 1), '') AS DOUBLE), 0.5) AS said
    FROM (SELECT *, CASE WHEN kind = 'OBJECT' THEN raw ELSE '{{}}' END AS raw2
          FROM (SELECT *, CASE WHEN json_valid(raw) THEN json_type(raw) END AS kind
                FROM (SELECT *, {_FENCELESS} AS raw FROM fx_match_replies))))) r
LEFT JOIN candidates c ON c.request_id = r.request_id AND c.position = r.place""", CANDIDATES)

# Streams -------------------------------------------------------------------------

ORACLES["audit_stream"] = """
SELECT event_id AS id, user_id AS target_id, event_type AS action, props AS detail, CAST(ts AS DATE) AS audit_date
FROM events"""
