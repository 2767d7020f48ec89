"""Order-dependent operators that stay parallel when one key holds most rows.

A window over a hot key would put that key's rows into one task. Here the rows of hot
keys are range-partitioned by (key, order), so that one key spans many slices; windows
run per (key, slice), and what must cross a slice border is carried by a table with one
row per (key, slice).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from inductra.session import cut_lineage, plain_union

SLICE = "_slice"

# A key with more rows than this is split; the session may set another number.
HOT_ROWS_SETTING = "spark.inductra.hotRows"
HOT_ROWS = 2_000_000

# Up to so many hot keys, and rows of one per (key, slice), are broadcast; more are joined.
BROADCAST_KEYS = 10_000
BROADCAST_SLICES = 30_000

UTC_NAMES = ("UTC", "ETC/UTC", "Z", "GMT")

# More than the number of different 64-bit ids, so ids never reach into the time.
ID_SPAN = 2 * 10**19


def micros(df: DataFrame, at: str) -> Column:
    """Microseconds of a time column as a decimal, in the column's own order.

    A zone-less time is not cast in a zone with clock changes: that would swap times
    around the missing hour.
    """
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    if isinstance(df.schema[at].dataType, TimestampNTZType) and zone.upper() not in UTC_NAMES:
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        seconds = (F.col(at) - epoch).cast("interval second").cast("decimal(18,6)")
        return (seconds * 1_000_000).cast("decimal(38,0)")
    return F.unix_micros(F.col(at).cast("timestamp")).cast("decimal(38,0)")


def order_number(df: DataFrame, at: str, row_id: str) -> Column:
    """One decimal that orders the rows of ``df`` by time, then by a 64-bit id.

    An aggregate over it has a fixed-width buffer and stays a hash aggregate, where a
    maximum over a (time, id) struct would sort all rows first.
    """
    return (micros(df, at) * F.expr(f"{ID_SPAN}BD") + F.col(row_id)).cast("decimal(38,0)")


UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

# Hex digits of a uuid in the first number; 60 bits beside the 64 of the time fit a decimal.
HEAD_DIGITS = 15


def uuid_order(df: DataFrame, at: str, row_id: str) -> tuple[Column, Column]:
    """Two decimals that together order rows by time, then by a uuid in lower-case text.

    The first one has the time and the head of the uuid, the second one the rest. An aggregate
    over the second per first, then over the first, has fixed-width buffers all the way. A
    text that is no uuid gives NULL.
    """
    digits = F.when(F.col(row_id).rlike(UUID_PATTERN), F.translate(F.col(row_id), "-", ""))

    def number(start: int, length: int) -> Column:
        return F.conv(F.substring(digits, start, length), 16, 10).cast("decimal(38,0)")

    rest = 32 - HEAD_DIGITS
    head = micros(df, at) * F.expr(f"{16**HEAD_DIGITS}BD") + number(1, HEAD_DIGITS)
    tail = number(HEAD_DIGITS + 1, rest - 2) * F.lit(256).cast("decimal(3,0)") + number(31, 2)
    return head.cast("decimal(38,0)"), tail.cast("decimal(38,0)")


def _same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Key equality in which NULL matches NULL."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[f"_hot_{key}"])
    return condition


def _hinted(df: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(df) if fits else df


def _wanted_slices(df: DataFrame, at_least: int = 1) -> int:
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _range_slices(df: DataFrame, keys: list[str], order: list[str], at_least: int = 1) -> DataFrame:
    """Rows with the number of their slice, stored so that the numbers never change."""
    wanted = _wanted_slices(df, at_least)
    sliced = df.repartitionByRange(wanted, *keys, *order).withColumn(SLICE, F.spark_partition_id())
    return cut_lineage(sliced)


def split_hot(
    df: DataFrame, keys: list[str], order: list[str], hot_rows: int | None
) -> tuple[DataFrame, DataFrame | None, bool]:
    """(rows of ordinary keys, sliced rows of hot keys or None, whether slices are few).

    Every key with more than ``hot_rows`` rows is hot, however many there are. Their list is a
    stored table; only its size decides how it is joined.
    """
    hot_rows = hot_rows or int(df.sparkSession.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS)))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows)
    n_keys, rows = counts.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    if not n_keys:
        return df, None, True
    hot = cut_lineage(counts.select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
    hot = _hinted(hot, n_keys <= BROADCAST_KEYS)
    ordinary = df.join(hot, _same_key(df, hot, keys), "left_anti")
    busy = df.join(hot, _same_key(df, hot, keys), "left_semi")
    slices = math.ceil(rows / hot_rows)
    few = n_keys + _wanted_slices(df, slices) <= BROADCAST_SLICES
    return ordinary, _range_slices(busy, keys, order, slices), few


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str, hot_rows: int | None = None
) -> DataFrame:
    """Add ``name``: the struct ``columns`` of the row before, per key; NULL on the first row.

    ``order`` must be unique within a key, and ``columns`` short values: the last row of
    each slice of a hot key is broadcast, or joined if there are very many.
    """
    def lagged(rows: DataFrame, by: list[str]) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumn(name, F.lag(F.struct(*columns)).over(window))

    ordinary, busy, few = split_hot(df, keys, order, hot_rows)
    out = lagged(ordinary, keys)
    if busy is None:
        return out
    tails = busy.groupBy(*keys, SLICE).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_tail"))
    carried = tails.select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys],
        F.col(SLICE).alias("_to"),
        F.lag("_tail").over(Window.partitionBy(*keys).orderBy(SLICE)).alias("_carried"),
    )
    inner = lagged(busy, [*keys, SLICE])
    # One row per (hot key, slice).
    joined = inner.join(
        _hinted(carried, few), _same_key(inner, carried, keys) & (inner[SLICE] == carried["_to"]), "left"
    )
    joined = joined.withColumn(name, F.coalesce(name, "_carried")).select(*out.columns)
    return out.unionByName(joined)


def lowest_running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, hot_rows: int | None = None
) -> DataFrame:
    """(keys, ``name``): the smallest running sum of ``value`` after any row, per key."""
    ordinary, busy, few = split_hot(df, keys, order, hot_rows)

    def running(rows: DataFrame, by: list[str]) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("_sum", F.sum(value).over(window))

    out = running(ordinary, keys).groupBy(*keys).agg(F.min("_sum").alias(name))
    if busy is None:
        return out
    # One row per (hot key, slice).
    slices = running(busy, [*keys, SLICE]).groupBy(*keys, SLICE).agg(
        F.min("_sum").alias("_low"), F.sum(value).alias("_total")
    )
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    low = F.col("_low") + F.coalesce(F.sum("_total").over(before), F.lit(0))
    return plain_union(out, slices.withColumn("_low", low).groupBy(*keys).agg(F.min("_low").alias(name)))


def number_within(
    df: DataFrame, keys: list[str], order: list[str], name: str, several: str | None = None, hot_rows: int | None = None
) -> DataFrame:
    """Add ``name``: the 1-based position of each row within its key.

    ``several``, if named, tells whether the key has more than one row.
    """
    ordinary, busy, few = split_hot(df, keys, order, hot_rows)
    window = Window.partitionBy(*keys).orderBy(*order)
    out = ordinary.withColumn(name, F.row_number().over(window).cast("bigint"))
    if several:
        follows = F.lead(F.lit(True)).over(window)
        out = out.withColumn(several, (F.col(name) > 1) | follows.isNotNull())
    if busy is None:
        return out
    numbered = _number_slices(busy, keys, order, name, few)
    if several:
        numbered = numbered.withColumn(several, F.lit(True))
    return out.unionByName(numbered.select(*out.columns))


def number_all(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``: 1, 2, 3, ... over the whole table in ``order``, without one big task.

    The table is cut into as many slices as the session has shuffle partitions.
    """
    few = _wanted_slices(df) <= BROADCAST_SLICES
    return _number_slices(_range_slices(df, [], order), [], order, name, few).select(*df.columns, name)


def _number_slices(sliced: DataFrame, keys: list[str], order: list[str], name: str, few: bool) -> DataFrame:
    counts = sliced.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per (key, slice), so this window is small even without a key.
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys],
        F.col(SLICE).alias("_to"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
    )
    local = sliced.withColumn(name, F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(*order)))
    joined = local.join(_hinted(offsets, few), _same_key(local, offsets, keys) & (local[SLICE] == offsets["_to"]))
    return joined.withColumn(name, F.col(name) + F.col("_offset"))
