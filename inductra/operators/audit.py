"""Audit log: writing entries, reading the newest, explaining field changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inductra.operators.access import viewer_identity
from inductra.operators.tables import newest_first

_KEEP_NULLS = {"ignoreNullFields": "false"}


def to_json_object(value: Column) -> Column:
    return F.to_json(value, _KEEP_NULLS)


def unwrap_json(value: Column | str) -> Column:
    """Old and new values written by the browser are JSON text inside a JSON string."""
    value = F.col(value) if isinstance(value, str) else value
    inner = F.try_variant_get(F.try_parse_json(value), "$", "string")
    return F.when(value.startswith('"'), inner).otherwise(value)


def write_audit(entries: DataFrame, employees: DataFrame) -> DataFrame:
    """Complete entries with the actor's id, name and role as of now.

    An actor without an employee row still leaves an entry, with NULLs.
    """
    who = viewer_identity(entries.withColumnRenamed("actor_auth_id", "viewer_auth_id"), employees)
    names = {"viewer_id": "actor_id", "viewer_name": "actor_name", "viewer_role": "actor_role"}
    return who.drop("viewer_auth_id").withColumnsRenamed(names)


def audit_latest(audit: DataFrame, n: int = 20) -> DataFrame:
    """The newest entries; sort and limit become one top-n step."""
    return newest_first(audit).limit(n)


def audit_changes(audit: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row per entry and field whose old and new values differ.

    ``fields`` gives the name and type of each field of the JSON objects.
    """
    schema = ", ".join(f"{name} {kind}" for name, kind in fields.items())
    old, new = (F.from_json(unwrap_json(side), schema) for side in ("old_value", "new_value"))
    parsed = audit.withColumns({"_old": old, "_new": new})
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                F.col(f"_old.{name}").cast("string").alias("old"),
                F.col(f"_new.{name}").cast("string").alias("new"),
            )
            for name in fields
        ]
    )
    changed = F.filter(pairs, lambda p: ~p["old"].eqNullSafe(p["new"]))
    return parsed.select("id", "target_id", "created_at", F.explode(changed).alias("_change")).select(
        "id", "target_id", "created_at", "_change.field", "_change.old", "_change.new"
    )
