"""Plain reads and table changes shared by the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inductra.schemas import LOCKED_COLUMNS, ROSTER_COLUMNS
from inductra.session import plain_union


def select_where(df: DataFrame, column: str, value, columns: list[str] | None = None) -> DataFrame:
    """Rows whose ``column`` equals ``value``; a literal filter reaches the scan."""
    found = df.filter(F.col(column) == F.lit(value))
    return found.select(*columns) if columns else found


def rows_for_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The bulk form of ``select_where``: rows whose key occurs in ``keys``."""
    return df.join(keys.select(column), column, "left_semi")


def newest_first(df: DataFrame, at: str = "created_at", tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(at).desc_nulls_first(), F.col(tie))


def oldest_first(df: DataFrame, at: str = "created_at", tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(at).asc_nulls_last(), F.col(tie))


def roster(employees: DataFrame) -> DataFrame:
    """The manager dashboard: fixed columns, newest employee first."""
    return newest_first(employees).select(*ROSTER_COLUMNS)


def roster_json(employees: DataFrame) -> DataFrame:
    """One JSON object per employee, nulls kept, in roster order.

    The result is a JSON-lines table. One array holding all employees would have to pass
    through a single task; an empty table has no lines.
    """
    return newest_first(employees).select(
        "id", F.to_json(F.struct(*ROSTER_COLUMNS), {"ignoreNullFields": "false"}).alias("value")
    )


def key_cardinality(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """How many rows of ``df`` each wanted key has: none, one or many."""
    wanted = keys.select(column).distinct()
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    return wanted.join(counts, column, "left").select(
        column,
        n.alias("n_rows"),
        F.when(n == 0, "none").when(n == 1, "one").otherwise("many").alias("cardinality"),
    )


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add the missing columns. A present column keeps its NULLs, as an INSERT would."""
    absent = {name: value for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(absent) if absent else df


def ensure_rows(keys: DataFrame, existing: DataFrame, column: str, defaults: dict[str, Column]) -> DataFrame:
    """``existing`` plus a default row for every key it lacks."""
    missing = keys.select(column).distinct().join(existing, column, "left_anti")
    fresh = missing.withColumns({n: v for n, v in defaults.items() if n != column})
    return plain_union(existing, fresh.select(*existing.columns))


def merge_snapshot(
    snapshot: DataFrame,
    changes: DataFrame,
    key: str,
    run_ts: Column,
    locked: tuple[str, ...] = LOCKED_COLUMNS,
    stamp: str = "updated_at",
    insert: bool = True,
) -> DataFrame:
    """The snapshot after ``changes`` (one row per key, any subset of its columns).

    Locked columns keep their stored value on update; changed rows get the run's time.
    The update side is one left join, so a small change set is broadcast by AQE and the
    snapshot is not shuffled; inserts need only the snapshot's keys.
    """
    changed = [c for c in changes.columns if c in snapshot.columns and c not in (key, stamp, *locked)]
    new = changes.select(
        F.col(key).alias("_key"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in changed]
    )
    joined = snapshot.join(new, snapshot[key] == new["_key"], "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))

    def updated(column: str) -> Column:
        if column in changed:
            return F.when(hit, F.col(f"_new_{column}")).otherwise(snapshot[column]).alias(column)
        if column == stamp:
            return F.when(hit, run_ts).otherwise(snapshot[column]).alias(column)
        return snapshot[column]

    out = joined.select(*[updated(c) for c in snapshot.columns])
    if not insert:
        return out
    added = changes.join(snapshot.select(key), key, "left_anti")
    absent = [f.name for f in snapshot.schema.fields if f.name not in changes.columns]
    added = added.withColumns({c: F.lit(None).cast(snapshot.schema[c].dataType) for c in absent})
    if stamp in snapshot.columns:
        added = added.withColumn(stamp, run_ts)
    return plain_union(out, added.select(*snapshot.columns))
