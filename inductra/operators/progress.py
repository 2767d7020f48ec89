"""Module progress: upserts in closed form, completion percentage, status rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inductra.operators.ordered import SLICE, lowest_running_sum, order_number, previous_value, split_hot, uuid_order
from inductra.schemas import MODULES
from inductra.session import plain_union

KEY = ("employee_id", "module_id")


REQUIRED = (*KEY, "answers", "completed", "submitted_at", "submission_id")


def complete_submissions(submissions: DataFrame, required: tuple[str, ...] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """Split off submissions that lack a required value.

    The accepted side is a plain conjunction of null tests, which the scan can use.
    """
    accepted, reason, lacking = submissions, F.lit(None).cast("string"), F.lit(False)
    for column in reversed(required):
        accepted = accepted.filter(F.col(column).isNotNull())
        reason = F.when(F.col(column).isNull(), F.lit(f"{column}:not_null")).otherwise(reason)
        lacking = lacking | F.col(column).isNull()
    return accepted, submissions.filter(lacking).withColumn("reason", reason)


def _fold(rows: DataFrame) -> DataFrame:
    """One row per (employee, module): its last state, first completion and first save."""
    return rows.groupBy(*KEY).agg(
        F.max("_last").alias("_last"),
        F.min("completed_at").alias("completed_at"),
        F.min("created_at").alias("created_at"),
    )


def _states(submissions: DataFrame) -> DataFrame:
    """Each submission as the state it would leave."""
    return submissions.select(
        *KEY,
        F.struct("submitted_at", "submission_id", "completed", "answers").alias("_last"),
        F.when(F.col("completed"), F.col("submitted_at")).alias("completed_at"),
        F.col("submitted_at").alias("created_at"),
    )


def _rows(folded: DataFrame) -> DataFrame:
    """Folded states as rows of the progress table."""
    return folded.select(
        *KEY, "_last.answers", "_last.completed", "completed_at", "created_at",
        F.col("_last.submitted_at").alias("updated_at"),
        F.col("_last.submission_id").alias("last_submission_id"),
    )


def _merged(submissions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Folded states over ``snapshot``; ``_stored`` is the state before, or NULL.

    A full join of two sides that are unique by key. A union folded again would be planned
    without an exchange where both sides are partitioned by the key already, and Spark does
    not keep that promise when the sides run with different partition counts.
    """
    order = ["submitted_at", "submission_id", "completed", "answers"]
    stored = snapshot.withColumnsRenamed({"updated_at": "submitted_at", "last_submission_id": "submission_id"})
    stored = stored.select(*KEY, F.struct(F.struct(*order).alias("_last"), "completed_at", "created_at").alias("_stored"))
    both = _fold(_states(submissions)).join(stored, list(KEY), "full")
    return both.select(
        *KEY,
        F.greatest("_last", "_stored._last").alias("_last"),
        F.least("completed_at", "_stored.completed_at").alias("completed_at"),
        F.least("created_at", "_stored.created_at").alias("created_at"),
        "_stored",
    )


def module_progress(submissions: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Net effect of saving every submission, one row per (employee, module).

    The last submission decides answers and completed; the first completion stays as
    ``completed_at`` even if a later submission takes the completion back. The fold does
    not depend on arrival order, and a stored result can be passed back as ``snapshot``.
    Aggregates are partial before the shuffle, so a busy employee is combined map-side.
    The last row is one struct maximum, so each row is sorted once. Keys are never NULL, as in the
    table; ``complete_submissions`` refuses such rows. The snapshot has one row per key.
    """
    return _rows(_fold(_states(submissions)) if snapshot is None else _merged(submissions, snapshot))


def completion_flags(submissions: DataFrame) -> DataFrame:
    """Only whether each (employee, module) is completed, as the last submission says.

    Answers are not read, and the buffers have fixed width, so this is a hash aggregate. Ids are
    64-bit numbers or uuids in text; rows whose text is no uuid are never the last.
    """
    if isinstance(submissions.schema["submission_id"].dataType, StringType):
        head, tail = uuid_order(submissions, "submitted_at", "submission_id")
        rows = submissions.select(*KEY, "completed", head.alias("_order"), tail.alias("_tail"))
        rows = _last_flag(rows, [*KEY, "_order"], "_tail")
    else:
        order = order_number(submissions, "submitted_at", "submission_id")
        rows = submissions.select(*KEY, "completed", order.alias("_order"))
    return _last_flag(rows, list(KEY), "_order")


def _last_flag(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, completed): the flag of the row with the largest ``order``."""
    folded = rows.groupBy(*keys).agg(
        F.max(order).alias("_last"), F.max(F.when(F.col("completed"), F.col(order))).alias("_last_done")
    )
    return folded.select(*keys, F.coalesce(F.col("_last") == F.col("_last_done"), F.lit(False)).alias("completed"))


def known_employees_only(progress: DataFrame, employees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split progress rows by whether their employee exists.

    Done after the fold: at most one row per module is left of each employee by then.
    """
    ids = employees.select(F.col("id").alias("employee_id"))
    unknown = progress.join(ids, "employee_id", "left_anti").withColumn("reason", F.lit("employee_id:foreign_key"))
    return progress.join(ids, "employee_id", "left_semi"), unknown


def sticky_status(pct: Column, prior: Column, lowest: Column) -> Column:
    """Current rule: once completed, an employee stays so while any module is done.

    ``lowest`` is the smallest percentage after any of the saves: at 0 the status was lost.
    """
    return (
        F.when(pct == 0, "pending").when((prior == "completed") & (lowest > 0), "completed").otherwise("in_progress")
    )


def regressing_status(pct: Column, prior: Column, lowest: Column) -> Column:
    """Older rule: below 100 % a completed employee falls back, and stays there."""
    return (
        F.when(pct == 0, "pending")
        .when((pct == 100) & (prior == "completed") & (lowest == 100), "completed")
        .when(pct > 0, "in_progress")
        .otherwise("pending")
    )


STATUS_RULES = {"sticky": sticky_status, "regressing": regressing_status}


def lowest_done(
    submissions: DataFrame, employees: DataFrame, stored: DataFrame | None = None, hot_rows: int | None = None
) -> DataFrame:
    """(employee_id, lowest): the fewest done modules after any save, of completed employees.

    Every save sets the status anew, so a status that was lost on the way does not come back;
    only employees stored as completed have one to lose. ``stored`` is the progress before the
    batch. Rows of a busy employee are worked on in slices of their order.
    """
    done_before = employees.where("completion_status = 'completed'").select(F.col("id").alias("employee_id"))
    rows = submissions.select(*KEY, "completed", "submitted_at", "submission_id").join(
        done_before, "employee_id", "left_semi"
    )
    order = ["submitted_at", "submission_id"]
    ordinary, busy, _ = split_hot(rows, ["employee_id"], order, hot_rows)
    # Dealt by employee once: both windows of ordinary employees run on that exchange.
    dealt = ordinary.repartition("employee_id")
    before = F.lag("completed").over(Window.partitionBy(*KEY).orderBy(*order))
    changes = _changes(dealt.withColumn("_before", before), "_before", stored)
    running = F.sum("_change").over(
        Window.partitionBy("employee_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    lowest = changes.withColumn("_sum", running).groupBy("employee_id").agg(F.min("_sum").alias("_low"))
    if busy is not None:
        steps = previous_value(busy.drop(SLICE), list(KEY), order, ["completed"], "_before", hot_rows)
        changes = _changes(steps, "_before.completed", stored)
        low = lowest_running_sum(changes, ["employee_id"], order, "_change", "_low", hot_rows)
        lowest = plain_union(lowest, low)
    if stored is None:
        return lowest.withColumnRenamed("_low", "lowest")
    counts = stored.groupBy("employee_id").agg(F.count_if("completed").alias("_start"))
    joined = lowest.join(counts, "employee_id", "left")
    return joined.select("employee_id", (F.col("_low") + F.coalesce("_start", F.lit(0))).alias("lowest"))


def _changes(steps: DataFrame, before: str, stored: DataFrame | None) -> DataFrame:
    """By how much each save changes the number of done modules."""
    was = F.col(before)
    if stored is not None:
        steps = steps.join(stored.select(*KEY, F.col("completed").alias("_stored")), list(KEY), "left")
        was = F.coalesce(was, F.col("_stored"))
    change = F.col("completed").cast("int") - F.coalesce(was, F.lit(False)).cast("int")
    return steps.select("employee_id", "submitted_at", "submission_id", change.alias("_change"))


def percentage(done: Column, total: int) -> Column:
    """Rounded half away from zero, as an exact decimal."""
    return F.round(done.cast("decimal(20,0)") / F.lit(total) * 100).cast("int")


def progress_pct(progress: DataFrame, employees: DataFrame, total: int = len(MODULES)) -> DataFrame:
    """Done modules and percentage per employee.

    Employees without any progress row keep their stored percentage: nothing was saved
    that would have made it change. Every completed module id counts, listed or not.
    Progress of unknown employees drops out here; ``known_employees_only`` reports it.
    """
    done = progress.groupBy("employee_id").agg(F.count_if("completed").alias("done"))
    kept = employees.select("id", "completion_status", F.col("progress_pct").alias("_stored"))
    joined = kept.join(done, kept["id"] == done["employee_id"], "left")
    return joined.select(
        kept["id"].alias("employee_id"),
        F.coalesce("done", F.lit(0)).alias("done"),
        F.coalesce(percentage(F.col("done"), total), F.col("_stored")).alias("progress_pct"),
        F.col("completion_status").alias("prior_status"),
        F.col("done").isNotNull().alias("touched"),
    )


def completion_status(
    with_pct: DataFrame, rule: str = "sticky", lowest: DataFrame | None = None, total: int = len(MODULES)
) -> DataFrame:
    """Status after a batch of saves; ``lowest`` as ``lowest_done`` gives it.

    Without ``lowest`` the batch counts as one save: only its final state is judged.
    """
    low = F.col("progress_pct")
    if lowest is not None:
        with_pct = with_pct.join(lowest, "employee_id", "left")
        low = F.coalesce(percentage(F.col("lowest"), total), low)
    status = STATUS_RULES[rule](F.col("progress_pct"), F.col("prior_status"), low)
    return with_pct.select(
        "employee_id", "done", "progress_pct",
        F.when(F.col("touched"), status).otherwise(F.col("prior_status")).alias("completion_status"),
    )


def in_range(with_pct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split off percentages outside 0..100, which the table's check refuses; a missing one passes."""
    fine = F.coalesce(F.col("progress_pct").between(0, 100), F.lit(True))
    return with_pct.filter(fine), with_pct.filter(~fine).withColumn("reason", F.lit("progress_pct:range"))


def save_progress(
    submissions: DataFrame, progress: DataFrame, employees: DataFrame, rule: str = "sticky", total: int = len(MODULES)
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole save: (progress rows, employees, rejected submissions and percentages).

    ``progress`` is what was stored before. Submissions that lack a value or whose employee is
    unknown are rejected, as is every submission of an employee whose percentage would leave
    its range; the stored rows of such an employee stay. Employees without an accepted
    submission are returned as they were; for the others percentage and status follow.
    """
    accepted, lacking = complete_submissions(submissions)
    known, unknown = known_employees_only(accepted, employees)
    merged = _merged(known, progress)
    flags = merged.select(*KEY, F.col("_last.completed").alias("completed"))
    touched = known.select("employee_id").distinct()
    pct = progress_pct(flags.join(touched, "employee_id", "left_semi"), employees, total)
    fine, refused = in_range(pct)
    refused_ids = refused.where("touched").select("employee_id")
    status = completion_status(fine, rule, lowest_done(known, employees, progress), total)
    new = status.select(
        F.col("employee_id").alias("id"),
        F.col("progress_pct").alias("_pct"),
        F.col("completion_status").alias("_status"),
    )
    columns = [
        F.coalesce("_pct", "progress_pct").alias("progress_pct") if c == "progress_pct"
        else F.coalesce("_status", "completion_status").alias("completion_status") if c == "completion_status"
        else F.col(c)
        for c in employees.columns
    ]
    saved_employees = employees.join(new, "id", "left").select(*columns)
    # Of refused employees the stored state, of all others the new one: one fold holds both.
    marked = merged.join(refused_ids.withColumn("_refused", F.lit(True)), "employee_id", "left")
    state = F.when(F.col("_refused"), F.col("_stored")).otherwise(F.struct("_last", "completed_at", "created_at"))
    saved = _rows(marked.select(*KEY, state.alias("_state")).where("_state IS NOT NULL").select(*KEY, "_state.*"))
    over = known.join(refused_ids, "employee_id", "left_semi").withColumn("reason", F.lit("progress_pct:range"))
    rejects = lacking.unionByName(unknown).unionByName(over)
    return saved, saved_employees, rejects
