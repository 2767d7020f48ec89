"""The whole save as one stream: progress rows, percentage and status from submissions.

State per employee is what a save needs to be repeated in the order of time, however files
arrive: the status stored before the stream, each module's last state, and the submissions that
a late one may still go before.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from inductra.operators.ordered import micros
from inductra.operators.progress import KEY, complete_submissions
from inductra.schemas import MODULES
from inductra.streaming.folders import ChangeFolders

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_MODULE = "module_id: string, answers: string, completed: boolean, completed_at: bigint, created_at: bigint, updated_at: bigint, last_submission_id: bigint"
_ENTRY = "at: bigint, id: bigint, module_id: string, completed: boolean"
STATE = f"""prior string, touched boolean, lowest bigint, folded_to bigint, base array<string>,
    modules array<struct<{_MODULE}>>, entries array<struct<{_ENTRY}>>"""
CHANGES = """kind string, employee_id bigint, done int, progress_pct int, completion_status string,
    module_id string, answers string, completed boolean, completed_at bigint, created_at bigint, updated_at bigint,
    last_submission_id bigint, submission_id bigint, reason string"""
TIMES = ("completed_at", "created_at", "updated_at")
_NAMES = [part.split()[0] for part in CHANGES.split(",")]
_CHANGE = Row(*_NAMES)
_WANTED = {
    "employee": ("done", "progress_pct", "completion_status"),
    "module": ("module_id", "answers", "completed", *TIMES, "last_submission_id"),
    "reject": ("submission_id",),
}


def rounded(done: int, total: int) -> int:
    """Percentage, rounded half up."""
    return (200 * done + total) // (2 * total)


def status_of(rule: str, pct: int, prior: str, lowest: int) -> str:
    """The two status rules; ``lowest`` is the smallest percentage after any save."""
    if pct == 0:
        return "pending"
    kept = lowest > 0 if rule == "sticky" else pct == 100 and lowest == 100
    return "completed" if prior == "completed" and kept else "in_progress"


class SavedEmployee:
    """What is known of one employee; plain values, so that it is easily stored."""

    def __init__(self, prior: str, touched=False, lowest=None, folded_to=None, base=(), modules=(), entries=()):
        self.prior, self.touched, self.lowest, self.folded_to = prior, touched, lowest, folded_to
        self.base = set(base)
        self.modules = {m[0]: tuple(m) for m in modules}
        self.entries = [tuple(e) for e in entries]

    def stored(self) -> tuple:
        return (
            self.prior, self.touched, self.lowest, self.folded_to, sorted(self.base), list(self.modules.values()), self.entries
        )

    def save(self, at: int, row_id: int, module: str, answers: str, completed: bool) -> None:
        known = self.modules.get(module)
        self.entries.append((at, row_id, module, completed))
        first = at if completed else None
        if known is None:
            self.modules[module] = (module, answers, completed, first, at, at, row_id)
            return
        done_at = min((t for t in (known[3], first) if t is not None), default=None)
        made_at = min(known[4], at)
        last = (answers, completed) if (at, row_id) >= (known[5], known[6]) else known[1:3]
        self.modules[module] = (module, *last, done_at, made_at, *max((known[5], known[6]), (at, row_id)))

    def replayed(self, upto: int | None = None) -> tuple[set[str], int | None]:
        """(done modules, fewest done after any save), of all saves or of those before ``upto``."""
        done, lowest = set(self.base), self.lowest
        for at, _, module, completed in self.entries:
            if upto is not None and at >= upto:
                break
            (done.add if completed else done.discard)(module)
            lowest = len(done) if lowest is None else min(lowest, len(done))
        return done, lowest

    def fold(self, upto: int) -> None:
        """Forget saves before ``upto``: nothing may go before them any more."""
        self.base, self.lowest = self.replayed(upto)
        self.entries = [e for e in self.entries if e[0] >= upto]
        self.folded_to = upto


class Saving(StatefulProcessor):
    """Saves the submissions of one employee; rows of ``CHANGES`` of three kinds."""

    def __init__(self, rule: str, total: int, lateness: int | None):
        self.rule, self.total, self.lateness = rule, total, lateness

    def init(self, handle) -> None:
        self.state = handle.getValueState("employee", STATE)

    def handleInitialState(self, key, row, timer_values) -> None:
        modules = [tuple(m.values()) if isinstance(m, dict) else tuple(m) for m in row["modules"] or ()]
        base = [m[0] for m in modules if m[2]]
        self.state.update(SavedEmployee(row["completion_status"], base=base, modules=modules).stored())

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        if not self.state.exists():
            # No such employee when the stream began.
            return iter([self._row("reject", key, r, "employee_id:foreign_key") for r in rows])
        before = self.state.get()
        employee, out, new = SavedEmployee(*before), [], []
        for r in rows:
            if employee.folded_to is not None and r["at"] < employee.folded_to:
                out.append(self._row("reject", key, r, "submitted_at:late"))
                continue
            employee.save(r["at"], r["submission_id"], r["module_id"], r["answers"], r["completed"])
            new.append((r["submission_id"], r["module_id"]))
        if not new:
            return iter(out)
        employee.entries.sort(key=lambda e: e[:2])
        employee.touched = True
        done, lowest = employee.replayed()
        pct = rounded(len(done), self.total)
        if pct > 100:
            refused = [self._row("reject", key, {"submission_id": i}, "progress_pct:range") for i, _ in new]
            return iter(out + refused)
        status = status_of(self.rule, pct, employee.prior, rounded(lowest, self.total))
        out.append(self._row("employee", key, {"done": len(done), "progress_pct": pct, "completion_status": status}))
        fields = ("module_id", "answers", "completed", *TIMES, "last_submission_id")
        for module in sorted({m for _, m in new}):
            out.append(self._row("module", key, dict(zip(fields, employee.modules[module]))))
        if self.lateness is not None:
            employee.fold(employee.entries[-1][0] - self.lateness)
        self.state.update(employee.stored())
        return iter(out)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(kind: str, key, values, reason: str | None = None) -> Row:
        # One per saved module, so field names are worked out beforehand.
        listed = dict.fromkeys(_NAMES)
        for name in _WANTED[kind]:
            listed[name] = values[name]
        listed["kind"], listed["employee_id"], listed["reason"] = kind, key[0], reason
        return _CHANGE(*listed.values())


def _time(column: str):
    """A zone-less time from microseconds, in any session zone."""
    epoch = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
    days, rest = f"CAST({column} div 86400000000 AS INT)", f"({column} % 86400000000)"
    return F.expr(f"{epoch} + make_dt_interval({days}, 0, 0, CAST({rest} AS DECIMAL(18,0)) / 1000000)")


def save_stream(
    submissions: DataFrame,
    progress: DataFrame,
    employees: DataFrame,
    path: str,
    checkpoint: str,
    rule: str = "sticky",
    total: int = len(MODULES),
    lateness: int | None = None,
    compact_every: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Keep progress, percentage and status of all employees up to date from a stream.

    The folders ``employees``, ``progress`` and ``rejects`` below ``path`` get a change folder
    per micro-batch. Whatever the order of arrival, the last changes are what one batch save of
    all submissions gives: saves are replayed in the order of (submitted_at, submission_id).
    ``lateness``, in microseconds, bounds what is kept for that: submissions older than the
    employee's newest one by more are rejected as late; without it all of them can still be
    placed. Submissions of employees unknown at the start are rejected, as are those of a batch
    that would take the percentage out of its range. Those that lack a required value do not
    enter; ``lacking_stream`` writes them. ``progress`` and ``employees`` are what was stored
    before and seed the state once. Needs the RocksDB state store, which is set here.
    """
    spark = submissions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    accepted, _ = complete_submissions(submissions)
    rows = accepted.select(
        "employee_id", "submission_id", "module_id", "answers", "completed",
        micros(accepted, "submitted_at").cast("bigint").alias("at"),
    )
    times = [micros(progress, t).cast("bigint").alias(t) for t in TIMES]
    kept = progress.select(*KEY, "answers", "completed", *times, "last_submission_id")
    fields = ["module_id", "answers", "completed", *TIMES, "last_submission_id"]
    stored = kept.groupBy("employee_id").agg(F.collect_list(F.struct(*fields)).alias("modules"))
    seed = employees.select(F.col("id").alias("employee_id"), "completion_status").join(stored, "employee_id", "left")
    changed = rows.groupBy("employee_id").transformWithState(
        Saving(rule, total, lateness), CHANGES, "Update", "None", seed.groupBy("employee_id")
    )
    folders = {kind: ChangeFolders(f"{path}/{name}", keys) for kind, name, keys in _KINDS}
    first = {kind: folder.first_batch(spark, checkpoint) for kind, folder in folders.items()}

    def write(batch: DataFrame, batch_id: int) -> None:
        # Three sinks read one result.
        batch.persist()
        for kind, columns in _COLUMNS.items():
            part = batch.where(F.col("kind") == kind)
            timed = part.withColumns({t: _time(t) for t in TIMES}) if kind == "module" else part
            folders[kind].write(timed.select(*columns), first[kind] + batch_id)
        batch.unpersist()
        if compact_every and batch_id and batch_id % compact_every == 0:
            for kind in ("employee", "module"):
                folders[kind].compact(spark)

    query = changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()


_KINDS = (
    ("employee", "employees", ("employee_id",)),
    ("module", "progress", KEY),
    ("reject", "rejects", ("submission_id",)),
)
_COLUMNS = {
    "employee": ["employee_id", "done", "progress_pct", "completion_status"],
    "module": [*KEY, "answers", "completed", *TIMES, "last_submission_id"],
    "reject": ["employee_id", "submission_id", "reason"],
}


def lacking_stream(submissions: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Submissions that lack a required value, with the first one missing."""
    _, rejected = complete_submissions(submissions)
    folder = ChangeFolders(f"{path}/lacking", ("submission_id",))
    wanted = rejected.select("employee_id", "submission_id", "reason")
    first = folder.first_batch(submissions.sparkSession, checkpoint)
    query = wanted.writeStream.foreachBatch(lambda batch, batch_id: folder.write(batch, first + batch_id))
    return query.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def saved_employees(spark: SparkSession, path: str, employees: DataFrame) -> DataFrame:
    """``employees`` with percentage and status as the stream left them."""
    changes = ChangeFolders(f"{path}/employees", ("employee_id",)).read(spark)
    if changes is None:
        return employees
    new = changes.select(
        F.col("employee_id").alias("id"), F.col("progress_pct").alias("_pct"), F.col("completion_status").alias("_status")
    )
    values = {
        "progress_pct": F.coalesce("_pct", "progress_pct"),
        "completion_status": F.coalesce("_status", "completion_status"),
    }
    return employees.join(new, "id", "left").withColumns(values).select(*employees.columns)
