"""Onboarding batches, employee codes and sequential ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inductra.functions.text import email_key, padded_number
from inductra.operators.access import administrators
from inductra.operators.links import users_by_email
from inductra.operators.ordered import number_all
from inductra.operators.people import DENIED
from inductra.operators.tables import with_defaults
from inductra.schemas import CODE_PREFIX, FIRST_CODE, LAST_CODE, MIN_PASSWORD_LENGTH

# Refusal messages, in the order they are tested.
NO_EMAIL = "Email is required"
SHORT_PASSWORD = "Password must be at least 6 characters"
NO_USER = "No auth user found"
LINKED = "This email is already linked to an employee record."
REPEATED = "Email repeated in this batch"
NO_CODE = "No employee code left"

# A prime that does not divide the size of the code space, so the walk meets every code.
CODE_STRIDE = 611_953

MODES = ("find_or_create", "must_exist", "create_always")


def judge_requests(
    requests: DataFrame, users: DataFrame, employees: DataFrame, mode: str = "find_or_create"
) -> DataFrame:
    """Requests for new employees with ``email_key``, ``user_id`` and ``reason``.

    ``find_or_create`` takes the user with the e-mail or makes one, ``must_exist`` needs
    one, ``create_always`` makes one without looking. A user has one employee: a request
    for a linked user is refused, and of several requests with one e-mail the smallest
    request id wins. ``reason`` is NULL for accepted rows; their ``user_id`` is NULL where
    a user is to be made.

    All that depends on the e-mail sits in one lookup with a row per e-mail, so requests
    are joined once, and an e-mail repeated many times is never gathered in one group.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    by_actor = requests.withColumnRenamed("actor_auth_id", "viewer_auth_id")
    who = by_actor.join(administrators(employees), "viewer_auth_id", "left")
    early = F.when(F.col("viewer_id").isNull(), DENIED)
    key = email_key("email")
    if mode == "find_or_create":
        short = F.col("password_length").isNull() | (F.col("password_length") < MIN_PASSWORD_LENGTH)
        early = early.when(key.isNull() | (key == ""), NO_EMAIL).when(short, SHORT_PASSWORD)
    judged = who.withColumns({"email_key": key, "_early": early})
    if mode == "create_always":
        judged = judged.withColumns({"reason": F.col("_early"), "user_id": F.lit(None).cast("bigint")})
    else:
        judged = _judge_by_email(judged, users, employees, mode)
    judged = judged.withColumnRenamed("viewer_auth_id", "actor_auth_id")
    return judged.select(*requests.columns, "email_key", "user_id", "reason")


def onboard(
    requests: DataFrame, users: DataFrame, employees: DataFrame, mode: str = "find_or_create"
) -> tuple[DataFrame, DataFrame]:
    """``judge_requests`` split into (accepted, rejected)."""
    judged = judge_requests(requests, users, employees, mode)
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def _judge_by_email(judged: DataFrame, users: DataFrame, employees: DataFrame, mode: str) -> DataFrame:
    candidates = judged.filter(F.col("_early").isNull() & F.col("email_key").isNotNull())
    first = candidates.groupBy("email_key").agg(F.min("request_id").alias("_first"))
    linked = employees.filter(F.col("auth_id").isNotNull()).select(F.col("auth_id").alias("user_id")).distinct()
    accounts = users_by_email(users).join(linked.withColumn("_linked", F.lit(True)), "user_id", "left")
    lookup = first.join(accounts, "email_key", "left")
    joined = judged.join(lookup, "email_key", "left")
    late = F.when(F.col("_linked"), LINKED).when(F.col("request_id") != F.col("_first"), REPEATED)
    if mode == "must_exist":
        late = F.when(F.col("user_id").isNull(), NO_USER).otherwise(late)
    return joined.withColumn("reason", F.coalesce("_early", late))


def free_codes(employees: DataFrame, wanted: int, seed: int = 0) -> DataFrame:
    """(_place, employee_code) of the first ``wanted`` free codes of the walk, and at most 63 more.

    The walk visits every code once in steps that look random. Used codes are bits at their step
    in 64-bit words, set by a partial aggregate; the free bits before each word are one running
    sum over at most 14,063 words, and only words that hold a wanted place are written out.
    """
    size = LAST_CODE - FIRST_CODE + 1
    number = F.try_to_number(F.substring("employee_code", len(CODE_PREFIX) + 1, 20), F.lit("999999")).cast("bigint")
    is_code = F.col("employee_code") == F.concat(F.lit(CODE_PREFIX), F.col("_n").cast("string"))
    used = employees.select("employee_code", number.alias("_n")).where(is_code & F.col("_n").between(FIRST_CODE, LAST_CODE))
    step = F.pmod((F.col("_n") - FIRST_CODE - seed) * F.lit(pow(CODE_STRIDE, -1, size)), F.lit(size))
    one = F.lit(1).cast("bigint")
    taken = used.groupBy(F.floor(step / 64).alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", one, (step % 64).cast("int"))).alias("_bits")
    )
    words = employees.sparkSession.range(-(-size // 64)).withColumnRenamed("id", "_word")
    # One row per word, so this window is bounded by the code space.
    marked = words.join(F.broadcast(taken), "_word", "left").withColumn("_bits", F.coalesce("_bits", F.lit(0).cast("bigint")))
    length = F.least(F.lit(64), F.lit(size) - F.col("_word") * 64).cast("int")
    free = length - F.bit_count("_bits")
    before = F.sum(free).over(Window.orderBy("_word")) - free
    counted = marked.select("_word", "_bits", length.alias("_length"), before.alias("_before")).where(F.col("_before") < wanted)
    bits = F.filter(
        F.sequence(F.lit(0), F.col("_length") - 1),
        lambda b: F.call_function("shiftright", F.col("_bits"), b).bitwiseAND(one) == 0,
    )
    open_bits = counted.where("bit_count(_bits) < _length").select("_word", "_before", F.posexplode(bits).alias("_rank", "_bit"))
    code = (F.lit(FIRST_CODE) + ((F.col("_word") * 64 + F.col("_bit")) * CODE_STRIDE + seed) % size).cast("string")
    return open_bits.select(
        (F.col("_before") + F.col("_rank") + 1).cast("bigint").alias("_place"), F.concat(F.lit(CODE_PREFIX), code).alias("employee_code")
    )


def assign_codes(requests: DataFrame, employees: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Give each request an unused employee code; (with code, rejected).

    The n-th request gets the n-th free code of the walk. No code is tried twice, and a run can
    be repeated. Requests beyond the last free code are rejected. What is shuffled grows with the
    requests, not with the code space.
    """
    numbered = number_all(requests, ["request_id"], "_place")
    wanted = numbered.agg(F.max("_place")).first()[0] or 0
    placed = numbered.join(free_codes(employees, wanted, seed), "_place", "left").drop("_place")
    rejected = placed.filter(F.col("employee_code").isNull()).withColumn("reason", F.lit(NO_CODE))
    return placed.filter(F.col("employee_code").isNotNull()), rejected


def create_employees(
    requests: DataFrame, users: DataFrame, employees: DataFrame, run_ts: Column, work_location: str, seed: int = 0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Onboarding from request to rows: (new users, new employees, rejected requests).

    An accepted request gets the user with its e-mail or a new one, an unused code, and an
    employee row that links the three. New ids run on from the largest stored ones, in the
    order of request ids. Every request is in the employees or in the rejects, once.
    """
    accepted, refused = onboard(requests, users, employees)
    coded, no_code = assign_codes(accepted, employees, seed)
    top_user = users.agg(F.max("id")).first()[0] or 0
    top_employee = employees.agg(F.max("id")).first()[0] or 0
    numbered = number_all(coded, ["request_id"], "_n")
    numbered = numbered.withColumn("id", F.col("_n") + F.lit(top_employee)).drop("_n")
    needed = number_all(numbered.where("user_id IS NULL").select("request_id", "email_key"), ["request_id"], "_n")
    made = needed.select("request_id", "email_key", (F.col("_n") + F.lit(top_user)).alias("_user"))
    new_users = made.select(F.col("_user").alias("id"), F.col("email_key").alias("email"), run_ts.alias("email_confirmed_at"))
    linked = numbered.join(made.select("request_id", "_user"), "request_id", "left")
    rows = linked.select(
        "id", "request_id", F.coalesce("user_id", "_user").alias("auth_id"), "employee_code", "full_name", "department", "position"
    )
    rows = with_defaults(
        rows,
        {
            "role": F.lit("employee"), "work_location": F.lit(work_location), "completion_status": F.lit("pending"),
            "progress_pct": F.lit(0), "start_date": run_ts.cast("date"), "created_at": run_ts,
        },
    )
    return new_users, rows, refused.unionByName(no_code.select(*refused.columns))


def sequential_ids(df: DataFrame, order: list[str], prefix: str, width: int = 6, start: int = 1) -> DataFrame:
    """Add ``employee_id``: prefix and padded running number in ``order``."""
    numbered = number_all(df, order, "_n")
    number = F.col("_n") + F.lit(start - 1)
    return numbered.withColumn("employee_id", F.concat(F.lit(prefix), padded_number(number, width))).drop("_n")
