"""Every registered query: an operator over the induction-shaped test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inductra.functions.labels import date_label, new_role, old_role, role_label, short_date, status_label
from inductra.functions.text import escape_html
from inductra.operators import access, audit, checks, links, onboarding, people, progress, rules, tables
from inductra.schemas import MODULES, ROLES
from inductra.session import run_folder
from inductra.sources import tables as sources
from inductra.sources.fixtures import fixture
from inductra.streaming import saving, streams

Query = Callable[[SparkSession, str], DataFrame]

PROFILE_TYPES = {"full_name": "string", "phone": "string", "age": "int", "position": "string", "department": "string"}
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def run_ts() -> Column:
    """The one clock of these runs, so that results repeat."""
    return F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")


# Progress ------------------------------------------------------------------------


def _progress(spark: SparkSession, sf: str) -> DataFrame:
    accepted, _ = progress.complete_submissions(fixture(spark, sf, "fx_submissions"))
    return progress.module_progress(accepted)


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    """Completion per (employee, module); of the answers only whether they are there is read."""
    accepted, _ = progress.complete_submissions(fixture(spark, sf, "fx_submissions"))
    return progress.completion_flags(accepted)


def _status(spark: SparkSession, sf: str, rule: str) -> DataFrame:
    employees = fixture(spark, sf, "fx_employees")
    accepted, _ = progress.complete_submissions(fixture(spark, sf, "fx_submissions"))
    fine, _ = progress.in_range(progress.progress_pct(_flags(spark, sf), employees))
    return progress.completion_status(fine, rule, progress.lowest_done(accepted, employees))


def _saved_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Submissions from the 15th on, the progress that the earlier ones made, employees."""
    rows = fixture(spark, sf, "fx_raw_submissions")
    early = F.coalesce(F.col("submitted_at") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), F.lit(False))
    stored, _ = progress.complete_submissions(rows.filter(early))
    employees = fixture(spark, sf, "fx_employees").where("id % 7 <> 3")
    before, _ = progress.known_employees_only(progress.module_progress(stored), employees)
    return rows.filter(~early), before, employees


def _save(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The late submissions saved over the earlier progress, as one batch."""
    return progress.save_progress(*_saved_inputs(spark, sf))


def _save_stream(spark: SparkSession, sf: str) -> tuple[str, DataFrame, DataFrame]:
    """The same save as a stream of files in the wrong order, two a batch, with a compaction; (folder, ...)."""
    rows, before, employees = _saved_inputs(spark, sf)
    root = run_folder(spark, "save-stream")
    rows.repartitionByRange(6, F.desc("submitted_at")).write.parquet(f"{root}/in")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    saving.save_stream(arriving, before, employees, root, f"{root}/checkpoint", compact_every=1).awaitTermination()
    return root, before, employees


@query
def module_progress_upsert(spark, sf):
    return _progress(spark, sf)


@query
def module_progress_merge(spark, sf):
    """Half the submissions become a snapshot, the rest are merged into it."""
    rows = fixture(spark, sf, "fx_submissions")
    early = F.coalesce(F.col("submitted_at") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), F.lit(False))
    snapshot = progress.module_progress(rows.filter(early))
    return progress.module_progress(rows.filter(~early), snapshot)


@query
def progress_status(spark, sf):
    return _status(spark, sf, "sticky")


@query
def progress_status_regressing(spark, sf):
    return _status(spark, sf, "regressing")


@query
def progress_status_uuid(spark, sf):
    """The current rule over submissions whose ids are uuids in text, which decide among equal times."""
    digest = F.md5(F.col("submission_id").cast("string"))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    accepted, _ = progress.complete_submissions(fixture(spark, sf, "fx_submissions"))
    named = accepted.withColumn("submission_id", F.concat_ws("-", *parts))
    # Whole days, so that many submissions of a module share their time.
    rows = named.withColumn("submitted_at", F.date_trunc("day", "submitted_at").cast("timestamp_ntz"))
    employees = fixture(spark, sf, "fx_employees")
    fine, _ = progress.in_range(progress.progress_pct(progress.completion_flags(rows), employees))
    return progress.completion_status(fine, "sticky", progress.lowest_done(rows, employees))


@query
def save_progress_rows(spark, sf):
    """The progress table after the whole save."""
    return _save(spark, sf)[0]


@query
def save_progress_employees(spark, sf):
    """The employees after the whole save."""
    return _save(spark, sf)[1].select("id", "progress_pct", "completion_status")


@query
def save_progress_rejects(spark, sf):
    """What the whole save refused, and why."""
    return _save(spark, sf)[2].select("submission_id", "reason")


@query
def save_stream_employees(spark, sf):
    """The employees after the save as a stream."""
    root, _, employees = _save_stream(spark, sf)
    return saving.saved_employees(spark, root, employees).select("id", "progress_pct", "completion_status")


@query
def save_stream_rows(spark, sf):
    """The progress table after the save as a stream."""
    root, before, _ = _save_stream(spark, sf)
    return streams.current_progress(spark, f"{root}/progress", before)


@query
def progress_rejects(spark, sf):
    """Progress rows of unknown employees, after the fold."""
    rows = fixture(spark, sf, "fx_dirty_progress").select(
        F.col("id").alias("submission_id"), "employee_id", "module_id", F.lit("{}").alias("answers"),
        F.lit(True).alias("completed"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("submitted_at"),
    )
    folded = progress.module_progress(rows)
    _, unknown = progress.known_employees_only(folded, fixture(spark, sf, "fx_employees"))
    return unknown.select("employee_id", "module_id", "last_submission_id", "reason")


@query
def submission_rejects(spark, sf):
    """Submissions that lack a required value, each with the first one missing."""
    _, rejected = progress.complete_submissions(fixture(spark, sf, "fx_raw_submissions"))
    return rejected.select("submission_id", "reason")


@query
def progress_out_of_range(spark, sf):
    """With a catalogue of four modules most percentages pass 100 and are refused."""
    _, refused = progress.in_range(progress.progress_pct(_flags(spark, sf), fixture(spark, sf, "fx_employees"), total=4))
    return refused.select("employee_id", "done", "progress_pct", "reason")


# Reads ---------------------------------------------------------------------------


@query
def email_by_code(spark, sf):
    return links.email_by_code(
        fixture(spark, sf, "fx_code_lookups"), fixture(spark, sf, "fx_employees"), fixture(spark, sf, "fx_users")
    )


@query
def link_report(spark, sf):
    return links.link_report(fixture(spark, sf, "fx_employees"), fixture(spark, sf, "fx_users"), "flags")


@query
def link_report_raw(spark, sf):
    return links.link_report(fixture(spark, sf, "fx_employees"), fixture(spark, sf, "fx_users"), "raw")


@query
def link_report_linked(spark, sf):
    return links.link_report(fixture(spark, sf, "fx_employees"), fixture(spark, sf, "fx_users"), "linked")


@query
def dashboard_roster(spark, sf):
    return tables.roster(fixture(spark, sf, "fx_employees"))


@query
def dashboard_for_manager(spark, sf):
    """The roster as one location manager asks for it."""
    return access.dashboard(fixture(spark, sf, "fx_employees"), 100050)


@query
def dashboard_json(spark, sf):
    return tables.roster_json(fixture(spark, sf, "fx_employees"))


@query
def roster_by_role(spark, sf):
    """Equality read with a fixed column list."""
    employees = fixture(spark, sf, "fx_employees")
    found = tables.select_where(employees, "role", "locationManager", ["id", "employee_code", "full_name", "role"])
    return found.orderBy("id")


@query
def rows_for_keys(spark, sf):
    """Bulk equality read: the employees the lookup table's customers stand for."""
    edits = fixture(spark, sf, "fx_profile_edits").select(F.col("emp_id").alias("id"))
    return tables.rows_for_keys(fixture(spark, sf, "fx_employees"), edits, "id").select("id", "full_name", "role")


@query
def key_cardinality(spark, sf):
    employees = fixture(spark, sf, "fx_employees").withColumnRenamed("auth_id", "viewer_auth_id")
    return tables.key_cardinality(employees, fixture(spark, sf, "fx_viewers"), "viewer_auth_id")


@query
def relink_changes(spark, sf):
    changed, _ = _relink(spark, sf)
    return changed


@query
def relink_rejects(spark, sf):
    _, rejected = _relink(spark, sf)
    return rejected


def _relink(spark, sf):
    return links.relink(
        fixture(spark, sf, "fx_links"), fixture(spark, sf, "fx_employees"), fixture(spark, sf, "fx_users")
    )


@query
def labels(spark, sf):
    return fixture(spark, sf, "fx_employees").select(
        "id",
        new_role(old_role("role")).alias("role"),
        role_label(old_role("role")).alias("role_label"),
        status_label("completion_status").alias("status_label"),
        date_label("completion_date").alias("completion_label"),
        date_label("created_at", with_time=True).alias("created_label"),
        short_date("start_date").alias("start_label"),
        escape_html(F.concat("full_name", F.lit(" <&'\">"))).alias("name_html"),
    )


# Profile edits and audit ---------------------------------------------------------


def _edits(spark, sf):
    employees = fixture(spark, sf, "fx_employees")
    allowed, rejected = people.judge_edits(fixture(spark, sf, "fx_profile_edits"), employees)
    return allowed, rejected, employees


def _audit(spark, sf) -> DataFrame:
    allowed, _, employees = _edits(spark, sf)
    return people.edit_audit(allowed, employees)


@query
def profile_edit_audit(spark, sf):
    return _audit(spark, sf)


@query
def profile_edit_rejects(spark, sf):
    _, rejected, _ = _edits(spark, sf)
    return rejected.select("edit_id", "emp_id", "viewer_auth_id", "reason")


@query
def profile_current(spark, sf):
    allowed, _, employees = _edits(spark, sf)
    return people.apply_profile_edits(employees, allowed, run_ts()).select(
        "id", *PROFILE_TYPES, "start_date", "induction_date", "updated_at"
    )


@query
def snapshot_merge(spark, sf):
    """Updates and inserts into the employees table; start dates offered by the change are ignored."""
    employees = fixture(spark, sf, "fx_employees").select("id", "full_name", "department", "start_date", "updated_at")
    changes = fixture(spark, sf, "fx_onboarding").groupBy(F.col("request_id").alias("id")).agg(
        F.min("full_name").alias("full_name"),
        F.lit("2030-01-01").cast("date").alias("start_date"),
    )
    return tables.merge_snapshot(employees, changes, "id", run_ts())


@query
def audit_field_changes(spark, sf):
    return audit.audit_changes(_audit(spark, sf), PROFILE_TYPES)


@query
def audit_latest_20(spark, sf):
    return audit.audit_latest(_audit(spark, sf)).select("id", "actor_name", "target_id", "action", "created_at")


@query
def audit_write(spark, sf):
    """Entries for employee actions; some actors have no employee row."""
    entries = fixture(spark, sf, "fx_actions").select(
        "action_id", (100000 + F.col("emp_id") * 7).alias("actor_auth_id"), F.col("emp_id").alias("target_id"),
        "action", F.col("acted_at").alias("created_at"),
    )
    return audit.write_audit(entries, fixture(spark, sf, "fx_employees"))


@query
def audit_append(spark, sf):
    """Two appends to a log on disk, read back with the day each entry is filed under."""
    path = run_folder(spark, "audit-log")
    actions = fixture(spark, sf, "fx_actions").withColumnsRenamed(
        {"action_id": "id", "emp_id": "target_id", "acted_at": "created_at"}
    )
    entries = audit.write_audit(actions, fixture(spark, sf, "fx_employees"))
    sources.append_audit(entries.filter(F.col("action") == "activate"), path, "first")
    sources.append_audit(entries.filter(F.col("action") != "activate"), path, "second")
    log = spark.read.parquet(path)
    return log.select("id", "actor_id", "target_id", "action", F.col("audit_date").cast("date").alias("audit_date"))


@query
def snapshot_swap(spark, sf):
    """Two versions of the employees table on disk; the reader follows the pointer to the second."""
    root = run_folder(spark, "employees")
    allowed, _, employees = _edits(spark, sf)
    sources.write_snapshot(employees, root, "first", run_ts())
    stored = sources.read_snapshot(spark, root)
    later = run_ts() + F.expr("INTERVAL '1' DAY")
    sources.write_snapshot(people.apply_profile_edits(stored, allowed, later), root, "second", later)
    return sources.read_snapshot(spark, root).select("id", "full_name", "department", "start_date", "updated_at")


# Deletion ------------------------------------------------------------------------


def _deletion(spark, sf) -> people.Deletion:
    deletions = fixture(spark, sf, "fx_actions").filter(F.col("action") == "delete").select(
        F.col("action_id").alias("deletion_id"), "emp_id", "actor_auth_id", F.col("acted_at").alias("deleted_at"),
    )
    return people.Deletion(deletions, fixture(spark, sf, "fx_employees"))


@query
def delete_employees(spark, sf):
    return _deletion(spark, sf).remaining_employees().select("id", "employee_code", "full_name")


@query
def delete_rejects(spark, sf):
    return _deletion(spark, sf).rejected.select("deletion_id", "emp_id", "reason")


@query
def delete_progress(spark, sf):
    left = _deletion(spark, sf).remaining_progress(_flags(spark, sf))
    return left.select("employee_id", "module_id", "completed")


@query
def delete_users(spark, sf):
    return _deletion(spark, sf).remaining_users(fixture(spark, sf, "fx_users")).select("id", "email")


@query
def delete_audit(spark, sf):
    """The log after the deletion: old entries without dead references, plus the new ones."""
    deletion = _deletion(spark, sf)
    columns = ["actor_id", "actor_name", "actor_role", "target_id", "action", "detail", "created_at"]
    old = deletion.without_references(_audit(spark, sf))
    return old.select(*columns).unionByName(deletion.entries().select(*columns))


# Older portal --------------------------------------------------------------------


@query
def induction_v1(spark, sf):
    return people.induction_state(fixture(spark, sf, "fx_induction_events"))


@query
def induction_ensure(spark, sf):
    state = people.induction_state(fixture(spark, sf, "fx_induction_events"))
    state = state.select("employee_id", "status", "progress_percent")
    keys = fixture(spark, sf, "fx_employees").select(F.col("id").alias("employee_id"))
    defaults = {"status": F.lit("not_started"), "progress_percent": F.lit(0)}
    return tables.ensure_rows(keys, state, "employee_id", defaults)


@query
def employee_actions_v1(spark, sf):
    employees = fixture(spark, sf, "fx_employees")
    allowed, _ = people.judge_actions(fixture(spark, sf, "fx_actions"), employees)
    left = people.employee_actions(employees, allowed)
    return left.select("id", "full_name", old_role("role").alias("role"), "status").orderBy("id")


@query
def employee_actions_rejects(spark, sf):
    """Actions of the older portal whose actor may not take them."""
    _, rejected = people.judge_actions(fixture(spark, sf, "fx_actions"), fixture(spark, sf, "fx_employees"))
    return rejected.select("action_id", "action", "reason")


@query
def create_v1(spark, sf):
    return people.create_from_forms(fixture(spark, sf, "fx_forms"))[0]


@query
def create_v1_rejects(spark, sf):
    return people.create_from_forms(fixture(spark, sf, "fx_forms"))[1].select("form_id", "email", "reason")


# Access --------------------------------------------------------------------------


@query
def viewer_identity(spark, sf):
    return access.viewer_identity(fixture(spark, sf, "fx_viewers"), fixture(spark, sf, "fx_employees"))


@query
def visible_employees(spark, sf):
    employees = fixture(spark, sf, "fx_employees")
    return access.visible_counts(employees, fixture(spark, sf, "fx_viewers"), employees, "employees", "id")


@query
def visible_progress(spark, sf):
    employees = fixture(spark, sf, "fx_employees")
    return access.visible_counts(
        _flags(spark, sf), fixture(spark, sf, "fx_viewers"), employees, "module_progress", "employee_id"
    )


@query
def visible_audit(spark, sf):
    employees = fixture(spark, sf, "fx_employees")
    return access.visible_counts(
        _audit(spark, sf), fixture(spark, sf, "fx_viewers"), employees, "audit_logs", "target_id"
    )


@query
def own_progress_rows(spark, sf):
    employees = fixture(spark, sf, "fx_employees")
    rows = _flags(spark, sf)
    return access.own_rows(rows, fixture(spark, sf, "fx_viewers"), employees, "module_progress", "employee_id")


@query
def progress_seen_by_manager(spark, sf):
    """Everything one location manager may read."""
    rows = _flags(spark, sf)
    return access.visible(rows, fixture(spark, sf, "fx_employees"), 100050, "module_progress")


@query
def write_authorised(spark, sf):
    edits = fixture(spark, sf, "fx_profile_edits").select(
        "edit_id", "emp_id",
        F.when(F.col("edit_id") % 2 == 0, F.col("actor_auth_id"))
        .otherwise(F.col("emp_id") + 100000)
        .alias("viewer_auth_id"),
    )
    return access.authorised(edits, fixture(spark, sf, "fx_employees"), "employees", "update", "emp_id").select(
        "edit_id", "viewer_role", "allowed", "outcome"
    )


@query
def write_moves(spark, sf):
    """Updates that move a progress row to another employee, judged on the old and the new row."""
    edits = fixture(spark, sf, "fx_profile_edits").select(
        "edit_id", "emp_id", (F.col("emp_id") + F.col("edit_id") % 3 - 1).alias("new_emp_id"),
        (100000 + F.col("emp_id") - F.col("edit_id") % 2).alias("viewer_auth_id"),
    )
    employees = fixture(spark, sf, "fx_employees")
    judged = access.authorised(edits, employees, "module_progress", "update", "emp_id", "new_emp_id")
    return judged.select("edit_id", "allowed", "outcome")


@query
def write_policies(spark, sf):
    """Every write policy against the same callers and owners."""
    edits = fixture(spark, sf, "fx_profile_edits").select(
        "edit_id", "emp_id", (100000 + F.col("emp_id") - F.col("edit_id") % 2).alias("viewer_auth_id")
    )
    judged = access.authorised_each(edits, fixture(spark, sf, "fx_employees"), "emp_id")
    return judged.select("policy", "edit_id", "allowed", "outcome")


# Quality rules -------------------------------------------------------------------


@query
def rule_violations(spark, sf):
    employees = fixture(spark, sf, "fx_dirty_employees")
    saved = fixture(spark, sf, "fx_dirty_progress")
    return rules.all_violations(
        rules.row_violations(
            employees, "id",
            [rules.not_null("full_name"), rules.in_range("progress_pct", 0, 100), rules.in_domain("role", ROLES)],
        ),
        rules.unique(employees, "employee_code"),
        rules.unique(saved, "employee_id", "module_id"),
        rules.foreign_key(employees, "auth_id", fixture(spark, sf, "fx_users"), "id"),
        rules.foreign_key(saved, "employee_id", employees, "id"),
        rules.in_catalogue(saved, "module_id", MODULES),
    )


# Onboarding ----------------------------------------------------------------------


def _onboard(spark, sf, mode):
    return onboarding.onboard(
        fixture(spark, sf, "fx_onboarding"), fixture(spark, sf, "fx_users"), fixture(spark, sf, "fx_employees"), mode
    )


def _decisions(spark, sf, mode):
    judged = onboarding.judge_requests(
        fixture(spark, sf, "fx_onboarding"), fixture(spark, sf, "fx_users"), fixture(spark, sf, "fx_employees"), mode
    )
    return judged.select("request_id", "email_key", "user_id", "reason")


@query
def onboarding_decisions(spark, sf):
    return _decisions(spark, sf, "find_or_create")


@query
def onboarding_must_exist(spark, sf):
    return _decisions(spark, sf, "must_exist")


@query
def onboarding_create_always(spark, sf):
    return _decisions(spark, sf, "create_always")


@query
def onboarding_new_rows(spark, sf):
    """Accepted requests as employee rows, with defaults for the columns they leave out."""
    accepted, _ = _onboard(spark, sf, "find_or_create")
    rows = accepted.select(F.col("user_id").alias("auth_id"), "request_id", "full_name", "department", "position")
    return tables.with_defaults(
        rows,
        {
            "role": F.lit("employee"), "work_location": F.lit("Main site"),
            "completion_status": F.lit("pending"), "progress_pct": F.lit(0),
            "start_date": run_ts().cast("date"), "created_at": run_ts(), "full_name": F.lit("unused"),
        },
    )


def _created(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    return onboarding.create_employees(
        fixture(spark, sf, "fx_onboarding"), fixture(spark, sf, "fx_users"), fixture(spark, sf, "fx_employees"),
        run_ts(), "Main site",
    )


@query
def onboarding_users(spark, sf):
    """The user rows that onboarding makes."""
    return _created(spark, sf)[0]


@query
def onboarding_employees(spark, sf):
    """The employee rows that onboarding makes, with code and link."""
    return _created(spark, sf)[1]


@query
def onboarding_rejects(spark, sf):
    """The requests that onboarding refuses."""
    return _created(spark, sf)[2].select("request_id", "reason")


@query
def batch_violations(spark, sf):
    """A fifth of the dirty employees as a batch over the others: codes and accounts taken, unknown accounts."""
    rows = fixture(spark, sf, "fx_dirty_employees")
    batch, stored = rows.where("id % 5 = 0"), rows.where("id % 5 <> 0")
    return rules.all_violations(
        rules.unique_in_batch(batch, stored, "employee_code"),
        rules.unique_in_batch(batch, stored, "auth_id"),
        rules.foreign_key_in_batch(batch, "auth_id", fixture(spark, sf, "fx_users"), "id"),
    )


@query
def new_codes(spark, sf):
    accepted, _ = _onboard(spark, sf, "find_or_create")
    coded, _ = onboarding.assign_codes(accepted.select("request_id"), fixture(spark, sf, "fx_employees"))
    return coded.select("request_id", "employee_code")


@query
def sequential_ids(spark, sf):
    employees = fixture(spark, sf, "fx_employees").select("id", "created_at")
    return onboarding.sequential_ids(employees, ["created_at", "id"], "STF")


# Product quality checks ----------------------------------------------------------


@query
def check_request_decisions(spark, sf):
    """All three kinds of test over one scan of the requests."""
    kinds = [F.struct(F.lit(k).alias("kind"), checks.refusal(k).alias("reason")) for k in ("question", "photo", "identify")]
    rows = fixture(spark, sf, "fx_check_requests").select("request_id", F.explode(F.array(*kinds)).alias("_test"))
    return rows.select("request_id", "_test.kind", "_test.reason")


@query
def photo_decode(spark, sf):
    return checks.decode_photos(fixture(spark, sf, "fx_check_requests")).select(
        "request_id", "mime_type", F.octet_length("photo").cast("bigint").alias("n_bytes"), F.md5("photo").alias("md5")
    )


def _bodies(spark, sf) -> DataFrame:
    """Request bodies whose product list and single product come from the row itself."""
    def product(name, category, description, reject_note, keywords):
        return F.struct(
            name.alias("name"), category.alias("category"), description.alias("description"),
            reject_note.alias("reject_note"), keywords.alias("keywords"),
        )

    rows = fixture(spark, sf, "fx_bodies")
    none = F.lit(None).cast("string")
    first = product(F.col("name_1"), F.col("category"), F.lit("clean"), F.col("reject_note"), F.col("single_name"))
    second = product(F.col("name_2"), none, F.lit(""), none, none)
    third = product(F.col("single_name"), F.col("category"), F.col("name_2"), F.lit("soft"), F.lit(""))
    products = F.when(F.col("has_list"), F.array(first, second, third))
    return rows.select("request_id", products.alias("products"), third.alias("product"))


@query
def product_context(spark, sf):
    return checks.product_context(_bodies(spark, sf)).select("request_id", "context")


@query
def product_context_json(spark, sf):
    """The same requests written as JSON bodies and read back."""
    path = run_folder(spark, "bodies")
    _bodies(spark, sf).write.json(path)
    return checks.product_context(sources.read_requests(spark, path)).select("request_id", "context")


@query
def product_blocks(spark, sf):
    return checks.product_blocks(fixture(spark, sf, "fx_product_requests"), fixture(spark, sf, "fx_products"))


@query
def candidate_list(spark, sf):
    """The list shown to the model for every body; a body without one has the reason instead."""
    rows = _bodies(spark, sf).withColumn("candidates", F.col("products"))
    reason = F.when(F.coalesce(F.size("candidates"), F.lit(0)) <= 0, checks.NO_CANDIDATES)
    return checks.candidate_list(rows).select("request_id", "candidate_text", reason.alias("reason"))


def _candidates(spark, sf):
    return checks.candidate_positions(
        fixture(spark, sf, "fx_product_requests"), fixture(spark, sf, "fx_products")
    )


@query
def candidate_lines(spark, sf):
    return _candidates(spark, sf).select("request_id", "position", "product_id", "line")


@query
def candidate_rejects(spark, sf):
    """Pairs whose product is unknown."""
    return checks.unknown_candidates(fixture(spark, sf, "fx_product_requests"), fixture(spark, sf, "fx_products"))


@query
def photo_prompt_parts(spark, sf):
    none = F.lit(None).cast("string")
    rows = fixture(spark, sf, "fx_check_requests").withColumns(
        {"description": F.lit("clean"), "reject_note": none, "keywords": F.lit("")}
    )
    accepted, _ = checks.validate_requests(rows, "photo")
    prepared, _ = checks.prompt_parts(accepted, fixture(spark, sf, "fx_reference_photos"))
    parts = prepared.select("request_id", F.posexplode("parts").alias("part_no", "part"))
    return parts.select("request_id", "part_no", "part.text", "part.mime_type", "part.data")


@query
def photo_prompt_rejects(spark, sf):
    none = F.lit(None).cast("string")
    rows = fixture(spark, sf, "fx_check_requests").withColumns(
        {"description": none, "reject_note": none, "keywords": none}
    )
    accepted, _ = checks.validate_requests(rows, "photo")
    _, rejected = checks.prompt_parts(accepted, fixture(spark, sf, "fx_reference_photos"))
    return rejected.select("request_id", "reason")


@query
def reply_texts(spark, sf):
    """Reply texts taken out of raw response bodies."""
    part = F.struct(F.array(F.struct(F.col("reply_text").alias("text"))).alias("parts"))
    body = F.to_json(F.struct(F.array(F.struct(part.alias("content"))).alias("candidates")))
    raw = fixture(spark, sf, "fx_attempts").select("request_id", "attempt_rank", body.alias("body"))
    return sources.with_reply_text(raw).drop("body")


@query
def attempt_problems(spark, sf):
    """Order lines read as attempts: line numbers past the model list, and repeated ones."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_orderkey").alias("request_id"), (F.col("l_linenumber") - 1).cast("bigint").alias("attempt_rank")
    )
    return checks.attempt_problems(lines)


@query
def verdicts(spark, sf):
    return checks.normalise_verdicts(fixture(spark, sf, "fx_attempts")).select(
        "request_id", "attempt_rank", "reply_status", "verdict", "confidence", "explanation"
    )


@query
def product_matches(spark, sf):
    replies, pairs = fixture(spark, sf, "fx_match_replies"), fixture(spark, sf, "fx_product_requests")
    return checks.match_pairs(replies, pairs, fixture(spark, sf, "fx_products")).drop("reply_text")


@query
def first_success(spark, sf):
    return checks.first_success(fixture(spark, sf, "fx_attempts"), "photo")


@query
def first_answer(spark, sf):
    return checks.first_success(fixture(spark, sf, "fx_attempts"), "question")


# Streams -------------------------------------------------------------------------


@query
def progress_stream(spark, sf):
    root = run_folder(spark, "progress-stream")
    rows = streams.submissions_of(streams.event_stream(spark, sf))
    streams.progress_stream(rows, f"{root}/changes", f"{root}/checkpoint").awaitTermination()
    return streams.current_progress(spark, f"{root}/changes")


@query
def audit_stream(spark, sf):
    """The events in files by falling time, a seventh of them again a day later, two files a batch."""
    root = run_folder(spark, "audit-stream")
    events = spark.read.schema(streams.EVENTS).parquet(f"{sf}/events.parquet")
    again = events.where("event_id % 7 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY")).repartition(2)
    # Repeats are delivered after the first six files.
    events.repartitionByRange(6, F.desc("ts")).write.parquet(f"{root}/in/events.parquet")
    entries = streams.audit_entries_of(streams.event_stream(spark, f"{root}/in", files_per_batch=2))
    streams.audit_stream(entries, f"{root}/log", f"{root}/checkpoint", compact_every=2).awaitTermination()
    again.write.mode("append").parquet(f"{root}/in/events.parquet")
    entries = streams.audit_entries_of(streams.event_stream(spark, f"{root}/in", files_per_batch=2))
    streams.audit_stream(entries, f"{root}/log", f"{root}/checkpoint", compact_every=2).awaitTermination()
    log = spark.read.parquet(f"{root}/log")
    return log.select("id", "target_id", "action", "detail", F.col("audit_date").cast("date").alias("audit_date"))
