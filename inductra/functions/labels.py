"""Display labels for roles, statuses and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inductra.functions.text import _col, or_default

# Role labels and the two spellings of role names.
ROLE_LABELS = {
    "employee": "Employee",
    "location_manager": "Location Manager",
    "sys_admin": "System Administrator",
}
OLD_TO_NEW_ROLE = {
    "employee": "employee",
    "location_manager": "locationManager",
    "sys_admin": "sysAdmin",
}
NEW_TO_OLD_ROLE = {new: old for old, new in OLD_TO_NEW_ROLE.items()}


def _lookup(value: Column, table: dict[str, str], default: Column) -> Column:
    pairs = [F.lit(item) for entry in table.items() for item in entry]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), default)


def role_label(value: Column | str) -> Column:
    return _lookup(_col(value), ROLE_LABELS, F.lit("Employee"))


def new_role(value: Column | str) -> Column:
    """Old role spelling to the current one; other values pass through."""
    return _lookup(_col(value), OLD_TO_NEW_ROLE, _col(value))


def old_role(value: Column | str) -> Column:
    return _lookup(_col(value), NEW_TO_OLD_ROLE, _col(value))


def status_label(value: Column | str) -> Column:
    return F.replace(or_default(value, "not_started"), F.lit("_"), F.lit(" "))


def date_label(value: Column | str, missing: str = "Not set", with_time: bool = False) -> Column:
    """``5 Mar 2024``, or ``5 Mar 2024, 2:05 pm`` for values that carry a time."""
    value = _col(value)
    label = F.date_format(value, "d MMM yyyy")
    if with_time:
        label = F.concat(label, F.lit(", "), F.lower(F.date_format(value, "h:mm a")))
    return F.coalesce(label, F.lit(missing))


def short_date(value: Column | str, missing: str = "—") -> Column:
    return F.coalesce(F.date_format(_col(value), "dd/MM/yyyy"), F.lit(missing))
