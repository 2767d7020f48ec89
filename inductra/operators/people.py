"""Changes to employees: profile edits, deletion, and the older portal's actions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inductra.functions.text import blank_to_null, trim_all
from inductra.operators.access import administrators, has_role, identities_with
from inductra.operators.audit import to_json_object
from inductra.operators.ordered import order_number, previous_value
from inductra.operators.tables import merge_snapshot
from inductra.schemas import ADMIN_ROLE, MANAGER_ROLES, PROFILE_FIELDS
from inductra.session import cut_lineage

# Audit texts.
EDIT_ACTION = "profile_edited"
EDIT_DETAIL = "SysAdmin edited employee profile"
DELETE_ACTION = "employee_deleted"
DELETE_DETAIL = "Deleted: "
DENIED = "Permission denied"

# Up to so many deleted ids, of 8 bytes each, are broadcast.
BROADCAST_IDS = 1_000_000

# What the older portal writes when an induction starts or completes.
START_MODULE = "Warehouse safety induction"
DONE_MODULE = "Completed"
START_PROGRESS = 10


def judge_edits(edits: DataFrame, employees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only system administrators may edit, and only existing employees; (allowed, rejected).

    ``allowed`` still holds edits of unknown employees, which the operators below drop in
    a join they need anyway; a join here would meet a hot employee before it is split.
    """
    known = employees.select(F.col("id").alias("emp_id"), F.lit(True).alias("_known"))
    by_actor = edits.withColumnRenamed("actor_auth_id", "viewer_auth_id")
    who = by_actor.join(administrators(employees), "viewer_auth_id", "left")
    may = F.col("viewer_id").isNotNull()
    reason = F.when(~may, DENIED).when(F.col("_known").isNull(), "emp_id:foreign_key")
    rejected = who.join(known, "emp_id", "left").withColumn("reason", reason).drop("_known")
    return who.filter(may), rejected.filter(F.col("reason").isNotNull())


def edit_audit(allowed: DataFrame, employees: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """An audit entry per edit with the profile before and after.

    The profile before the first edit is the stored one, before later edits the edit
    before. One employee may own most edits; ``previous_value`` keeps that parallel.
    """
    fields = list(PROFILE_FIELDS)
    chained = previous_value(allowed, ["emp_id"], ["edited_at", "edit_id"], fields, "_before", hot_rows)
    stored = employees.select(F.col("id").alias("emp_id"), F.struct(*fields).alias("_stored"))
    joined = chained.join(stored, "emp_id")
    return joined.select(
        F.col("edit_id").alias("id"),
        F.col("viewer_id").alias("actor_id"),
        F.col("viewer_name").alias("actor_name"),
        F.col("viewer_role").alias("actor_role"),
        F.col("emp_id").alias("target_id"),
        F.lit(EDIT_ACTION).alias("action"),
        F.lit(EDIT_DETAIL).alias("detail"),
        to_json_object(F.coalesce("_before", "_stored")).alias("old_value"),
        to_json_object(F.struct(*fields)).alias("new_value"),
        F.col("edited_at").alias("created_at"),
    )


def last_edits(allowed: DataFrame) -> DataFrame:
    """The five profile fields as the last edit of each employee leaves them."""
    last = F.max(F.struct("edited_at", "edit_id", *PROFILE_FIELDS)).alias("_last")
    folded = allowed.groupBy(F.col("emp_id").alias("id")).agg(last)
    return folded.select("id", *[F.col(f"_last.{f}") for f in PROFILE_FIELDS])


def apply_profile_edits(employees: DataFrame, allowed: DataFrame, run_ts: Column) -> DataFrame:
    return merge_snapshot(employees, last_edits(allowed), "id", run_ts, insert=False)


class Deletion:
    """A batch of employee deletions (deletion_id, emp_id, actor_auth_id, deleted_at).

    Progress rows and the linked account go with the employee, log entries lose their
    reference, and each deletion is logged by name. Only system administrators may delete.
    """

    def __init__(self, deletions: DataFrame, employees: DataFrame):
        self.employees = employees
        by_actor = deletions.withColumnRenamed("actor_auth_id", "viewer_auth_id")
        who = by_actor.join(administrators(employees), "viewer_auth_id", "left")
        may = F.col("viewer_id").isNotNull()
        self.rejected = who.filter(~may).withColumn("reason", F.lit(DENIED))
        self.allowed = who.filter(may)

    @cached_property
    def wanted(self) -> DataFrame:
        """One row per deleted employee, stored once: every method below reads it again."""
        first = F.struct("deleted_at", "deletion_id", "viewer_id", "viewer_name", "viewer_role")
        return cut_lineage(self.allowed.groupBy("emp_id").agg(F.min(first).alias("_first")))

    @property
    def gone(self) -> DataFrame:
        return self.wanted.select(F.col("emp_id").alias("id"))

    def remaining_employees(self) -> DataFrame:
        return self.employees.join(self.gone, "id", "left_anti")

    def remaining_progress(self, progress: DataFrame) -> DataFrame:
        return progress.join(self.gone.withColumnRenamed("id", "employee_id"), "employee_id", "left_anti")

    def remaining_users(self, users: DataFrame) -> DataFrame:
        accounts = self.employees.join(self.gone, "id", "left_semi").select(F.col("auth_id").alias("id"))
        return users.join(accounts.filter("id IS NOT NULL"), "id", "left_anti")

    def without_references(self, audit: DataFrame) -> DataFrame:
        """Existing log entries, with deleted actors and targets set to NULL.

        The log is not shuffled where the deleted ids are few enough to be broadcast, which is
        counted; more of them are joined, once for each reference.
        """
        few = self.gone.count() <= BROADCAST_IDS
        out = audit
        for column in ("actor_id", "target_id"):
            ids = self.gone.select(F.col("id").alias("_gone"))
            out = out.join(F.broadcast(ids) if few else ids, F.col(column) == F.col("_gone"), "left")
            out = out.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")
        return out.select(*audit.columns)

    def entries(self, actor_read: str = "before") -> DataFrame:
        """One new log entry per deleted id; an unknown id leaves a NULL detail.

        With ``actor_read='after'`` an administrator who deletes their own row leaves no
        entry, as the actor is gone by then; with ``'before'`` the entry keeps name and
        role but no actor id.
        """
        names = self.employees.select(F.col("id").alias("emp_id"), "full_name")
        gone_actors = self.gone.select(F.col("id").alias("_gone"))
        actor = F.col("_first.viewer_id")
        wanted = self.wanted
        if actor_read == "after":
            wanted = wanted.filter(F.col("emp_id") != actor)
        joined = wanted.join(names, "emp_id", "left").join(gone_actors, actor == F.col("_gone"), "left")
        return joined.select(
            F.when(F.col("_gone").isNull(), actor).alias("actor_id"),
            F.col("_first.viewer_name").alias("actor_name"),
            F.col("_first.viewer_role").alias("actor_role"),
            F.lit(None).cast("bigint").alias("target_id"),
            F.lit(DELETE_ACTION).alias("action"),
            F.concat(F.lit(DELETE_DETAIL), "full_name").alias("detail"),
            F.lit(None).cast("string").alias("old_value"),
            F.lit(None).cast("string").alias("new_value"),
            F.col("_first.deleted_at").alias("created_at"),
        )


def induction_state(events: DataFrame) -> DataFrame:
    """Older portal: each employee's induction record after all start and complete events."""
    acts = events.filter(F.col("action").isin("start", "complete"))
    done = F.col("action") == "complete"
    order = order_number(events, "happened_at", "event_id")
    folded = acts.groupBy("employee_id").agg(
        F.max(order).alias("_last"),
        F.max(F.when(done, order)).alias("_last_done"),
        F.bool_or(done).alias("declaration_accepted"),
        F.max(F.when(done, F.col("happened_at"))).alias("completed_at"),
    )
    last_done = F.coalesce(F.col("_last") == F.col("_last_done"), F.lit(False))
    return folded.select(
        "employee_id",
        F.when(last_done, "completed").otherwise("in_progress").alias("status"),
        F.when(F.col("declaration_accepted"), 100).otherwise(START_PROGRESS).alias("progress_percent"),
        F.when(last_done, DONE_MODULE).otherwise(START_MODULE).alias("current_module"),
        "declaration_accepted",
        F.col("completed_at").alias("declaration_accepted_at"),
        "completed_at",
    )


def judge_actions(actions: DataFrame, employees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Older portal: managers activate and set inactive, system administrators also delete; (allowed, rejected)."""
    by_actor = actions.withColumnRenamed("actor_auth_id", "viewer_auth_id")
    who = by_actor.join(identities_with(employees, MANAGER_ROLES), "viewer_auth_id", "left")
    role = F.col("viewer_role")
    may = has_role(role, (ADMIN_ROLE,)) | ((F.col("action") != "delete") & has_role(role, MANAGER_ROLES))
    may = F.coalesce(may, F.lit(False))
    judged = who.withColumnRenamed("viewer_auth_id", "actor_auth_id")
    rejected = judged.filter(~may).withColumn("reason", F.lit(DENIED))
    return judged.filter(may).select(*actions.columns), rejected.select(*actions.columns, "reason")


def employee_actions(employees: DataFrame, actions: DataFrame, default_status: str = "invited") -> DataFrame:
    """Older portal: activate, set inactive, delete. A deletion is final."""
    order = order_number(actions, "acted_at", "action_id")
    folded = actions.groupBy(F.col("emp_id").alias("id")).agg(
        F.bool_or(F.col("action") == "delete").alias("_deleted"),
        F.max(order).alias("_last"),
        F.max(F.when(F.col("action") == "activate", order)).alias("_last_active"),
    )
    joined = employees.join(folded, "id", "left")
    left = joined.filter(~F.coalesce("_deleted", F.lit(False)))
    status = (
        F.when(F.col("_last").isNull(), default_status)
        .when(F.col("_last") == F.col("_last_active"), "active")
        .otherwise("inactive")
    )
    return left.withColumn("status", status).drop("_deleted", "_last", "_last_active")


def create_from_forms(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Older portal: employee rows from cleaned form fields; (accepted, rejected).

    Managers may create employees; only a system administrator may give another role.
    """
    may = has_role(F.col("actor_role"), ("location_manager", "sys_admin"))
    cleaned = forms.select(
        "form_id", "actor_role",
        trim_all("full_name").alias("full_name"),
        trim_all("email").alias("email"),
        blank_to_null("phone").alias("phone"),
        trim_all("department").alias("department"),
        trim_all("position").alias("position"),
        F.when(has_role(F.col("actor_role"), ("sys_admin",)), F.col("role")).otherwise("employee").alias("role"),
        F.lit("invited").alias("status"),
    )
    return cleaned.filter(may).drop("actor_role"), cleaned.filter(~may).withColumn("reason", F.lit(DENIED))
