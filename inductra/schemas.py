"""Declared columns of the core tables."""

from __future__ import annotations

# Enum members, module catalogue and limits of the data model.
ROLES = ("employee", "locationManager", "sysAdmin")
MANAGER_ROLES = ("locationManager", "sysAdmin")
ADMIN_ROLE = "sysAdmin"
STATUSES = ("pending", "in_progress", "completed")
MODULES = (
    "generalRules", "ppe", "emergency", "manual", "forklift", "fire",
    "coldchain", "waste", "warehouse", "housekeeping", "incident", "rights",
)
CODE_PREFIX = "EMP"
FIRST_CODE, LAST_CODE = 100_000, 999_999
MIN_PASSWORD_LENGTH = 6

EMPLOYEES = """
    id bigint, auth_id bigint, employee_code string, full_name string, phone string,
    age int, work_location string, department string, position string, role string,
    start_date date, induction_date date, completion_status string, completion_date date,
    employee_signature string, supervisor_name string, supervisor_signature string,
    knowledge_viewed array<string>, progress_pct int,
    created_at timestamp_ntz, updated_at timestamp_ntz
"""

MODULE_PROGRESS = """
    employee_id bigint, module_id string, answers string, completed boolean,
    completed_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz,
    last_submission_id bigint
"""

AUDIT_LOGS = """
    id bigint, actor_id bigint, actor_name string, actor_role string, target_id bigint,
    action string, detail string, old_value string, new_value string,
    created_at timestamp_ntz
"""

USERS = "id bigint, email string, email_confirmed_at timestamp_ntz"

SUBMISSIONS = """
    submission_id bigint, employee_id bigint, module_id string, answers string,
    completed boolean, submitted_at timestamp_ntz
"""

# Columns of the manager roster, in order.
ROSTER_COLUMNS = (
    "id", "employee_code", "full_name", "phone", "age", "work_location", "department",
    "position", "role", "start_date", "induction_date", "completion_status",
    "completion_date", "progress_pct", "employee_signature", "supervisor_name",
    "supervisor_signature",
)

PROFILE_FIELDS = ("full_name", "phone", "age", "position", "department")
LOCKED_COLUMNS = ("start_date", "induction_date")
