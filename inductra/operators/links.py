"""Links between employees and user accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inductra.functions.text import code_key, email_key

NULL_SALTS = 64


def left_join_by_link(employees: DataFrame, users: DataFrame) -> DataFrame:
    """Employees with their user's columns as ``user_*``; unlinked employees stay.

    Employees without a link may be most of the table. A NULL key would send them all to
    one task, so they get a second key that spreads them and matches nothing.
    """
    left = employees.withColumn(
        "_salt",
        F.when(F.col("auth_id").isNull(), 1 + F.pmod(F.xxhash64("id"), F.lit(NULL_SALTS)).cast("int")).otherwise(0),
    )
    right = users.select(*[F.col(c).alias(f"user_{c}") for c in users.columns], F.lit(0).alias("_user_salt"))
    on = (left["auth_id"] == right["user_id"]) & (left["_salt"] == right["_user_salt"])
    return left.join(right, on, "left").drop("_salt", "_user_salt")


def link_report(employees: DataFrame, users: DataFrame, shape: str = "flags") -> DataFrame:
    """Every employee with the state of their account link, in one of three shapes."""
    joined = left_join_by_link(employees, users)
    confirmed = F.col("user_email_confirmed_at").isNotNull()
    linked = F.col("auth_id").isNotNull()
    base = ["id", "employee_code", "full_name", "role"]
    email = F.col("user_email").alias("email")
    if shape == "raw":
        out = joined.select(
            *base, "department", "auth_id", email, F.col("user_email_confirmed_at").alias("email_confirmed_at"),
            "created_at",
        )
    elif shape == "flags":
        out = joined.select(*base, linked.alias("has_auth"), email, confirmed.alias("is_confirmed"), "created_at")
    elif shape == "linked":
        out = joined.select(*base, email, confirmed.alias("confirmed"), linked.alias("linked"), "created_at")
    else:
        raise ValueError(f"unknown shape {shape!r}")
    by_time = F.col("created_at") if shape == "linked" else F.col("created_at").desc()
    return out.orderBy(by_time, "id").drop("created_at")


def email_by_code(lookups: DataFrame, employees: DataFrame, users: DataFrame) -> DataFrame:
    """E-mail for each looked-up employee code, NULL when there is none.

    Where several employees share a code but for case, the smallest id with an account
    wins. The code table is reduced to one row per code first, so the lookups meet it in
    a single unique-key join.
    """
    linked = employees.filter(F.col("auth_id").isNotNull()).select("id", "auth_id", code_key("employee_code").alias("_code"))
    accounts = users.select(F.col("id").alias("auth_id"), "email")
    by_code = linked.join(accounts, "auth_id").groupBy("_code").agg(F.min_by("email", "id").alias("email"))
    wanted = lookups.withColumn("_code", code_key("code"))
    return wanted.join(by_code, "_code", "left").drop("_code")


def users_by_email(users: DataFrame) -> DataFrame:
    """One user per normal e-mail: the smallest id."""
    return (
        users.filter(F.col("email").isNotNull())
        .groupBy(F.lower("email").alias("email_key"))
        .agg(F.min("id").alias("user_id"))
    )


def relink(links: DataFrame, employees: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Point employees at the user with their e-mail; (changed, rejected).

    A link changes when it is missing or differs. An e-mail without a user changes
    nothing. A user has one employee at most: a claim on a user another employee holds is
    rejected, and of several claims on one free user the smallest employee id wins.
    """
    wanted = links.select("employee_id", email_key("email").alias("email_key"))
    found = wanted.join(users_by_email(users), "email_key")
    current = employees.select(F.col("id").alias("employee_id"), F.col("auth_id").alias("old_auth_id"))
    claims = (
        found.join(current, "employee_id")
        .filter(F.col("old_auth_id").isNull() | (F.col("old_auth_id") != F.col("user_id")))
        .select("employee_id", "old_auth_id", F.col("user_id").alias("new_auth_id"))
    )
    holders = (
        employees.filter(F.col("auth_id").isNotNull())
        .groupBy(F.col("auth_id").alias("new_auth_id"))
        .agg(F.min("id").alias("holder_id"))
    )
    first = claims.groupBy("new_auth_id").agg(F.min("employee_id").alias("first_id"))
    judged = claims.join(first.join(holders, "new_auth_id", "left"), "new_auth_id").withColumn(
        "reason",
        F.when(F.col("holder_id").isNotNull(), "already_linked").when(
            F.col("employee_id") != F.col("first_id"), "claimed_in_batch"
        ),
    )
    changed = judged.filter(F.col("reason").isNull()).select("employee_id", "old_auth_id", "new_auth_id")
    rejected = judged.filter(F.col("reason").isNotNull()).select("employee_id", "old_auth_id", "new_auth_id", "reason")
    return changed, rejected
