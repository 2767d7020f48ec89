"""Repair of conversations by the cheapest edits that give every one a legal structure.

Legal role initials are ``(s?(ua)+)?``. Rows of a conversation stand in the order of turn (a
missing one first), role and text. Blank rows and repetitions must be deleted; a row that ends
without a stop may stay at a price. Among the cheapest edits those whose initials (Delete, Insert,
Keep, Rerole) come first in ASCII are taken.

The costs to the end are vectors of one number per state of the structure. Vectors are stored
only at the ends of blocks of about square root of all rows; a block is computed again from the
vector at its end while the edits are walked forward. Rows are range-partitioned in their order,
so a conversation that holds a third of all rows spans many tasks: each gives its blocks as
matrices of costs from state to state, products of these give the vectors at block ends, and the
state that each block starts in follows from what the blocks before do. A conversation that lies
in one task and one block is repaired on the spot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inductra.llm.common import join_groups, store, tidy

#: The cost of an edit, and of leaving a row that ends without a stop.
DELETE, INSERT, REROLE, UNENDED = 4, 3, 3, 3

#: A block has at least so many rows, and is cut once its texts have so many bytes.
LEAST_BLOCK = 64
BLOCK_BYTES = 4 << 20

BLANKS = " \t\n\x0b\x0c\r"
STATES = range(4)  # nothing yet, after system, after user, after assistant
ENDS = (0, 3)
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: State and role after a row with the role that has to follow.
FOLLOW = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
NEVER = 1 << 60

SOUND, LAPSE, GONE = 0, 1, 2  # what a row may be: kept, kept at a price, only deleted

COUNTS = "n_rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
TURNS = "min_turn bigint, max_turn bigint, n_turns bigint"
ROWS = "array<struct<role: string, text: string>>"
BLOCK = f"{COUNTS}, {TURNS}, first_initial string, last_initial string, matrix array<bigint>, marks string, rows {ROWS}"


def with_inserts(costs: list[int]) -> list[int]:
    """Costs by state once rows may be inserted before going on."""
    out = list(costs)
    for _ in STATES:
        for s in STATES:
            out[s] = min(out[s], INSERT + out[FOLLOW[s][0]])
    return out


def before_row(after: list[int], initial: str, mark: int) -> list[int]:
    """Costs by state in front of a row, from those behind it."""
    out = [DELETE + c for c in after]
    if mark != GONE:
        price = UNENDED if mark == LAPSE else 0
        for s in STATES:
            kept = KEEP.get((initial, s))
            if kept is not None:
                out[s] = min(out[s], price + after[kept])
            out[s] = min(out[s], REROLE + price + after[FOLLOW[s][0]])
    return [min(c, NEVER) for c in with_inserts(out)]


def at_end() -> list[int]:
    """Costs by state behind the last row of a conversation."""
    return with_inserts([0 if s in ENDS else NEVER for s in STATES])


def matrix(initials: list[str], marks: list[int]) -> list[int]:
    """Costs from each state in front of a block to each state behind it, row by row."""
    columns = []
    for t in STATES:
        costs = [0 if s == t else NEVER for s in STATES]
        for initial, mark in zip(reversed(initials), reversed(marks)):
            costs = before_row(costs, initial, mark)
        columns.append(costs)
    return [columns[t][s] for s in STATES for t in STATES]


def walk(
    rows: list[dict], marks: list[int], after: list[int], state: int, last: bool
) -> tuple[str, list[dict], int]:
    """(edit initials, repaired rows, state behind) of a block that starts in ``state``.

    ``after`` are the costs behind the block; of the last block also the rows inserted there.
    """
    n = len(rows)
    vectors: list[list[int]] = [after] * (n + 1)
    for i in range(n - 1, -1, -1):
        vectors[i] = before_row(vectors[i + 1], rows[i]["role"][:1], marks[i])
    audit, out, i = [], [], 0
    while i < n or (last and state not in ENDS):
        want, (next_state, next_role) = vectors[i][state], FOLLOW[state]
        if i < n and DELETE + vectors[i + 1][state] == want:
            audit.append("D")
            i += 1
            continue
        if INSERT + vectors[i][next_state] == want:
            audit.append("I")
            out.append({"role": next_role, "text": ""})
            state = next_state
            continue
        role, price = rows[i]["role"], UNENDED if marks[i] == LAPSE else 0
        kept = KEEP.get((role[:1], state))
        if kept is not None and price + vectors[i + 1][kept] == want:
            audit.append("K")
            state = kept
        else:
            audit.append("R")
            role, state = next_role, next_state
        out.append({"role": role, "text": rows[i]["text"]})
        i += 1
    return "".join(audit), out, state


class Block:
    """Rows of one conversation in order, with what is counted about them."""

    def __init__(self):
        self.rows: list[dict] = []
        self.marks: list[int] = []
        self.initials: list[str] = []
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.low, self.high = 0, None, None

    def add(self, row: dict, copy: int) -> None:
        """A row, or a further copy of it, which is a repetition if it is not blank."""
        repeated = not row["blank"] and (row["repeated"] or copy > 0)
        lapse = not row["blank"] and not repeated and row["unended"]
        self.blank += row["blank"]
        self.duplicate += repeated
        self.truncated += lapse
        mark = GONE if row["blank"] or repeated else LAPSE if lapse else SOUND
        initial, turn = row["role"][:1], row["turn"]
        if self.initials and self.initials[-1] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        self.initials.append(initial)
        self.marks.append(mark)
        # A row that must go needs no text any more.
        self.rows.append({"role": row["role"], "text": "" if mark == GONE else row["text"]})
        self.size += 50 + (0 if mark == GONE else len(row["text"]))

    def counts(self) -> dict:
        return {
            "n_rows": len(self.rows), "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.illegal, "min_turn": self.low, "max_turn": self.high, "n_turns": self.turns,
        }

    def repaired(self) -> dict:
        """A whole conversation, in one part."""
        end = at_end()
        start = end
        for initial, mark in zip(reversed(self.initials), reversed(self.marks)):
            start = before_row(start, initial, mark)
        audit, out, _ = walk(self.rows, self.marks, end, 0, True)
        return {**self.counts(), "part": 0, "parts": 1, "cost": start[0], "audit": audit, "repaired": out}

    def stored(self) -> dict:
        """A block of a conversation that goes on elsewhere."""
        return {
            **self.counts(), "first_initial": self.initials[0], "last_initial": self.initials[-1],
            "matrix": matrix(self.initials, self.marks), "marks": "".join(map(str, self.marks)), "rows": self.rows,
        }


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _arrow_type(kind: str) -> pa.DataType:
    if kind.startswith("array<struct"):
        return pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    return {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}.get(
        kind, pa.string()
    )


def _schemas(ddl: str) -> tuple[StructType, pa.Schema]:
    kind = StructType.fromDDL(ddl)
    return kind, pa.schema([(f.name, _arrow_type(f.dataType.simpleString())) for f in kind.fields])


def judged_rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct rows (conv, turn, role, text, copies) with blank, repeated and unended.

    Repetitions of a role and text that come at one turn are counted, not numbered; those at
    later turns are found by joining with the first turn, where a pair has several.
    """
    shown = F.lit(" ")
    rows = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), shown).alias("role"),
        F.coalesce(F.col(text), shown).alias("text"),
    )
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    of = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("-"))
    key = F.sha2(F.concat_ws(":", F.length(of), of, F.length("role"), "role", "text").cast("binary"), 256)
    rows = rows.withColumn("__key", key)
    at = F.struct(F.col("turn").isNotNull().alias("dated"), "turn")
    firsts = rows.groupBy("__key").agg(F.min(at).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    joined = join_groups(rows, store(firsts.drop("__n"), "conversation-firsts"), "__key", F.xxhash64("turn"))
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    return joined.select(
        "conv", "turn", "role", "text", "copies",
        (trimmed == "").alias("blank"),
        F.coalesce(at > F.col("__first"), F.lit(False)).alias("repeated"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("unended"),
    )


def repair(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    block_rows: int | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Repaired conversations, in one part or, if long, in several (conv, part, parts, ...).

    A part has its counts (n_rows, blank, duplicate, truncated, illegal: neighbours whose role
    initials are not su, ua or au, the first one with the row before), its turns (min_turn,
    max_turn, n_turns: distinct ones that no earlier part has), ``cost`` of the whole
    conversation, ``audit``, the initials of the part's edits, and ``repaired``, its rows (role,
    text) after them. A missing role or text counts as one blank; a missing turn comes first, a
    missing conversation id is a conversation of its own. Rows of one turn are ordered by role
    and text; equal rows are repetitions of the first. Other columns are not read. An empty
    table gives no rows; a conversation without rows is not there.
    """
    rows = judged_rows(df, conv, turn, role, text)
    order = ["conv", "turn", "role", "text"]
    most = block_rows or max(LEAST_BLOCK, isqrt(df.count()))
    conv_type = rows.schema["conv"].dataType.simpleString()
    found, shape = _schemas(
        f"conv {conv_type}, whole boolean, block bigint, {BLOCK}, part bigint, parts bigint, cost bigint,"
        f" audit string, repaired {ROWS}"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[dict] = []
        number = size = 0
        # The first and the last conversation of a task may go on in another one.
        current, block, alone = None, None, False

        def close(whole: bool) -> None:
            nonlocal number, size
            size += block.size
            if whole:
                ready.append({"conv": current[0], "whole": True, **block.repaired()})
            else:
                ready.append({"conv": current[0], "whole": False, "block": (here << 32) + number, **block.stored()})
                number += 1

        here = 0
        for batch in batches:
            for row in batch.to_pylist():
                here = row["slice"]
                if current is None or current[0] != row["conv"]:
                    if current is not None:
                        close(alone)
                    # Complete on the spot: neither the task's first nor its last, and one block.
                    alone = current is not None
                    current, block = (row["conv"],), Block()
                for copy in range(row["copies"]):
                    if len(block.rows) >= most or block.size >= block_bytes:
                        close(False)
                        block, alone = Block(), False
                    block.add(row, copy)
                if size >= block_bytes:
                    yield _arrow(ready, shape)
                    ready.clear()
                    size = 0
            tidy()
        if current is not None:
            close(False)
            yield _arrow(ready, shape)

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id())
    done = store(ordered.mapInArrow(run, found), "conversation-blocks")
    kept = ["conv", "part", "parts", *StructType.fromDDL(f"{COUNTS}, {TURNS}").fieldNames(), "cost", "audit", "repaired"]
    return done.where("whole").select(*kept).unionByName(_long(done.where("NOT whole"), kept))


def _long(blocks: DataFrame, kept: list[str]) -> DataFrame:
    """Parts of conversations that lie in several blocks."""
    conv_type = blocks.schema["conv"].dataType.simpleString()
    narrow = blocks.select("conv", "block", "matrix", "first_initial", "last_initial", "min_turn", "max_turn", "n_turns")
    marks, marks_shape = _schemas(
        "block bigint, part bigint, parts bigint, cost bigint, after array<bigint>, crossing bigint, shared bigint"
    )

    def vectors(group: pa.Table) -> pa.Table:
        """The stored vectors: costs behind every block, from the last one back."""
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        costs, high = at_end(), None
        for i in range(len(rows) - 1, -1, -1):
            m = rows[i]["matrix"]
            rows[i]["after"] = costs
            costs = [min(min(m[4 * s + t] + costs[t] for t in STATES), NEVER) for s in STATES]
        for i, row in enumerate(rows):
            joint = rows[i - 1]["last_initial"] + row["first_initial"] if i else "su"
            row |= {"part": i, "parts": len(rows), "cost": costs[0], "crossing": int(joint not in ("su", "ua", "au"))}
            row["shared"] = int(high is not None and row["min_turn"] == high)
            high = row["max_turn"] if row["max_turn"] is not None else high
        return pa.Table.from_batches([_arrow(rows, marks_shape)])

    known = store(narrow.groupBy("conv").applyInArrow(vectors, marks), "conversation-vectors")
    ready = blocks.drop("part", "parts", "cost", "audit", "repaired").join(known, "block")

    state_kind, state_shape = _schemas(f"conv {conv_type}, block bigint, behind array<bigint>")

    def behind(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state behind each block for every state in front of it."""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                marked = list(map(int, r["marks"]))
                ends = [walk(r["rows"], marked, r["after"], s, False)[2] for s in STATES]
                out.append({"conv": r["conv"], "block": r["block"], "behind": ends})
            yield _arrow(out, state_shape)

    start_kind, start_shape = _schemas("block bigint, start bigint")

    def starts(group: pa.Table) -> pa.Table:
        state, out = 0, []
        for r in sorted(group.to_pylist(), key=lambda r: r["block"]):
            out.append({"block": r["block"], "start": state})
            state = r["behind"][state]
        return pa.Table.from_batches([_arrow(out, start_shape)])

    chained = ready.select("conv", "block", "marks", "rows", "after").mapInArrow(behind, state_kind)
    begun = chained.groupBy("conv").applyInArrow(starts, start_kind)
    part_kind, part_shape = _schemas(
        f"conv {conv_type}, part bigint, parts bigint, {COUNTS}, {TURNS}, cost bigint, audit string, repaired {ROWS}"
    )

    def edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                last = r["part"] == r["parts"] - 1
                audit, out, _ = walk(r["rows"], list(map(int, r["marks"])), r["after"], r["start"], last)
                yield _arrow([{**r, "audit": audit, "repaired": out}], part_shape)
            tidy()

    whole = ready.withColumns(
        {"illegal": F.col("illegal") + F.col("crossing"), "n_turns": F.col("n_turns") - F.col("shared")}
    ).join(begun, "block")
    wanted = [f.name for f in part_shape if f.name not in ("audit", "repaired")]
    return whole.select(*wanted, "marks", "rows", "after", "start").mapInArrow(edits, part_kind).select(*kept)


def summarise(parts: DataFrame) -> DataFrame:
    """One row per conversation: counts, gaps in its turns, cost, audit and repaired_sha256.

    The digest is of lines ``role:text`` joined by line feeds. Conversations in several parts are
    streamed part by part, in order, each through one task; a digest allows no other way.
    """
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps")
    line = F.transform("repaired", lambda r: F.concat(r.role, F.lit(":"), r.text))
    columns = ["conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    single = parts.where("parts = 1").withColumn("repaired_sha256", F.sha2(F.array_join(line, "\n").cast("binary"), 256))
    several = parts.where("parts > 1")
    digest_kind, digest_shape = _schemas(f"conv {parts.schema['conv'].dataType.simpleString()}, audit string, repaired_sha256 string")

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit: list[str] = []
        digest, empty = hashlib.sha256(), True
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] == 0:
                    audit, digest, empty = [], hashlib.sha256(), True
                audit.append(r["audit"])
                for row in r["repaired"]:
                    digest.update((("" if empty else "\n") + row["role"] + ":" + row["text"]).encode())
                    empty = False
                if r["part"] == r["parts"] - 1:
                    found = {"conv": r["conv"], "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
                    yield _arrow([found], digest_shape)

    streamed = several.select("conv", "part", "parts", "audit", "repaired")
    streamed = streamed.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(digests, digest_kind)
    counts = several.groupBy(F.col("conv").alias("of")).agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "n_turns")],
        F.min("min_turn").alias("min_turn"), F.max("max_turn").alias("max_turn"), F.max("cost").alias("cost"),
    )
    long = streamed.join(counts, F.col("conv").eqNullSafe(F.col("of")))
    return single.select(*columns).unionByName(long.select(*columns))
