"""Who may see or change which rows.

Tests on a role that is unknown count as refused. The source of these rules lets a
caller without an employee row through some of them, because NULL is neither equal nor
unequal; that accident is not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from inductra.operators.tables import roster
from inductra.schemas import ADMIN_ROLE, MANAGER_ROLES

ANYONE = ("*",)

# At most this many rows of id, name and role are broadcast.
SMALL_ROWS = 100_000

# For each table: the roles that read everything, and whether one's own rows are readable.
READ_POLICIES = {
    "employees": (MANAGER_ROLES, True),
    "module_progress": (MANAGER_ROLES, True),
    "audit_logs": ((ADMIN_ROLE,), False),
}

# For each (table, action): roles that may do it on any row, and whether owners may.
WRITE_POLICIES = {
    ("employees", "insert"): ((ADMIN_ROLE,), False),
    ("employees", "update"): (MANAGER_ROLES, True),
    ("employees", "delete"): ((ADMIN_ROLE,), False),
    ("module_progress", "insert"): ((), True),
    ("module_progress", "update"): ((), True),
    ("module_progress", "delete"): ((), True),
    # Anyone signed in may add to the log; nobody may change it.
    ("audit_logs", "insert"): (ANYONE, False),
    ("audit_logs", "update"): ((), False),
    ("audit_logs", "delete"): ((), False),
}


def has_role(role: Column, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(role.isin(*allowed), F.lit(False)) if allowed else F.lit(False)


def identities(employees: DataFrame) -> DataFrame:
    """One identity per user account: the linked employee with the smallest id."""
    return (
        employees.filter(F.col("auth_id").isNotNull())
        .groupBy(F.col("auth_id").alias("viewer_auth_id"))
        .agg(
            F.min("id").alias("viewer_id"),
            F.min_by("full_name", "id").alias("viewer_name"),
            F.min_by("role", "id").alias("viewer_role"),
        )
    )


def identities_with(employees: DataFrame, roles: tuple[str, ...], max_rows: int = SMALL_ROWS) -> DataFrame:
    """Identities that have one of some privileged roles.

    Changes are checked against these few rows, so a batch in which one administrator made
    most changes is not shuffled by actor. The role is filtered at the scan, and only accounts
    left by that are folded. A count of the filtered rows, stopped at the bound, allows the
    broadcast; beyond the bound it is an ordinary join.
    """
    holders = employees.filter(F.col("role").isin(*roles) & F.col("auth_id").isNotNull())
    fits = holders.select("id").limit(max_rows + 1).count() <= max_rows
    accounts = holders.select(F.col("auth_id").alias("_account")).distinct()
    accounts = F.broadcast(accounts) if fits else accounts
    folded = identities(employees.join(accounts, F.col("auth_id") == F.col("_account"), "left_semi"))
    found = folded.filter(F.col("viewer_role").isin(*roles))
    return F.broadcast(found) if fits else found


def administrators(employees: DataFrame) -> DataFrame:
    """Identities of the system administrators."""
    return identities_with(employees, (ADMIN_ROLE,))


def viewer_identity(viewers: DataFrame, employees: DataFrame) -> DataFrame:
    """Employee id, name and role of each viewer; NULLs for an account without employee."""
    return viewers.join(identities(employees), "viewer_auth_id", "left")


def _lookup_viewer(employees: DataFrame, viewer_auth_id) -> Row | None:
    """Id and role behind one account: at most one row comes to the driver."""
    mine = employees.filter(F.col("auth_id") == F.lit(viewer_auth_id)).orderBy("id").select("id", "role").limit(1)
    return mine.first()


def visible(df: DataFrame, employees: DataFrame, viewer_auth_id, table: str) -> DataFrame:
    """The rows one viewer may read.

    The viewer's identity is a one-row lookup; the policy then becomes a literal filter
    that is pushed into the scan.
    """
    all_roles, own = READ_POLICIES[table]
    me = _lookup_viewer(employees, viewer_auth_id)
    if me and me["role"] in all_roles:
        return df
    owner = "id" if table == "employees" else "employee_id"
    if me and own:
        return df.filter(F.col(owner) == F.lit(me["id"]))
    return df.filter(F.lit(False))


def dashboard(employees: DataFrame, viewer_auth_id) -> DataFrame:
    """The roster for one viewer, who has to be a manager; others are refused, not filtered."""
    me = _lookup_viewer(employees, viewer_auth_id)
    if not me or me["role"] not in MANAGER_ROLES:
        raise PermissionError("Permission denied")
    return roster(employees)


def read_scopes(viewers: DataFrame, employees: DataFrame, table: str) -> DataFrame:
    """Per viewer: ``all``, ``own`` or ``none``."""
    all_roles, own = READ_POLICIES[table]
    who = viewer_identity(viewers, employees)
    own_rows = F.col("viewer_id").isNotNull() if own else F.lit(False)
    scope = F.when(has_role(F.col("viewer_role"), all_roles), "all").when(own_rows, "own").otherwise("none")
    return who.withColumn("scope", scope)


def visible_counts(df: DataFrame, viewers: DataFrame, employees: DataFrame, table: str, owner: str) -> DataFrame:
    """How many rows each viewer may read.

    Managers see the whole table, so viewer-row pairs would grow as managers times rows.
    The count needs none: the table size is one scalar, own rows are one small aggregate.
    """
    scopes = read_scopes(viewers, employees, table)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    if READ_POLICIES[table][1]:
        own = df.groupBy(F.col(owner).alias("viewer_id")).agg(F.count(F.lit(1)).alias("_own"))
        scopes = scopes.join(own, "viewer_id", "left")
    else:
        scopes = scopes.withColumn("_own", F.lit(0))
    return scopes.select(
        "viewer_auth_id", "viewer_role", "scope",
        F.when(F.col("scope") == "all", total)
        .when(F.col("scope") == "own", F.coalesce("_own", F.lit(0)))
        .otherwise(F.lit(0))
        .alias("visible_rows"),
    )


def own_rows(df: DataFrame, viewers: DataFrame, employees: DataFrame, table: str, owner: str) -> DataFrame:
    """The rows of ``df`` that viewers with scope ``own`` may read, with the viewer added."""
    mine = read_scopes(viewers, employees, table).filter(F.col("scope") == "own").select("viewer_auth_id", "viewer_id")
    return df.join(mine, df[owner] == mine["viewer_id"]).drop("viewer_id")


def write_test(table: str, action: str, owner: str, new_owner: str | None = None) -> tuple[Column, Column]:
    """(allowed, outcome) for changes joined with their caller's identity.

    A refused insert is an error; a refused update or delete touches no row. The update
    policies have no test of their own for the row as it will be, so theirs holds for it as
    well: with ``new_owner``, moving a row to somebody else is an error unless the caller
    could change that one too.
    """
    roles, own = WRITE_POLICIES[(table, action)]

    def test(column: str) -> Column:
        if roles == ANYONE:
            return F.col("viewer_auth_id").isNotNull()
        mine = F.coalesce(F.col("viewer_id") == F.col(column), F.lit(False)) if own else F.lit(False)
        return has_role(F.col("viewer_role"), roles) | mine

    allowed = test(owner)
    refused = F.lit("rejected" if action == "insert" else "no_rows")
    if new_owner and action == "update":
        refused = F.when(allowed, "rejected").otherwise(refused)
        allowed = allowed & test(new_owner)
    return allowed, F.when(allowed, "applied").otherwise(refused)


def authorised(
    changes: DataFrame, employees: DataFrame, table: str, action: str, owner: str, new_owner: str | None = None
) -> DataFrame:
    """``changes`` (with ``viewer_auth_id``) plus ``allowed`` and ``outcome``."""
    allowed, outcome = write_test(table, action, owner, new_owner)
    return viewer_identity(changes, employees).withColumns({"allowed": allowed, "outcome": outcome})


def authorised_each(changes: DataFrame, employees: DataFrame, owner: str) -> DataFrame:
    """``changes`` under every write policy, one row per policy, after a single join."""
    tests = []
    for table, action in WRITE_POLICIES:
        allowed, outcome = write_test(table, action, owner)
        policy = F.lit(f"{table}:{action}")
        tests.append(F.struct(policy.alias("policy"), allowed.alias("allowed"), outcome.alias("outcome")))
    who = viewer_identity(changes, employees).withColumn("_test", F.explode(F.array(*tests)))
    return who.select(*changes.columns, "_test.*")
