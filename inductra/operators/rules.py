"""Data-quality rules over a table. Each violation is (rule, row_key, n_rows).

Row rules name the offending row. Key rules name the offending key value and count its
rows; they aggregate before they shuffle, so a value shared by most rows costs one row
per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Up to so many distinct keys of a batch, of some 50 bytes each, are broadcast.
BROADCAST_BATCH_KEYS = 500_000


def not_null(column: str) -> tuple[str, Column]:
    return f"{column}:not_null", F.col(column).isNull()


def in_range(column: str, low, high) -> tuple[str, Column]:
    """A NULL passes, as it does a table's check."""
    return f"{column}:range", ~F.col(column).between(low, high)


def in_domain(column: str, values: tuple[str, ...]) -> tuple[str, Column]:
    return f"{column}:domain", ~F.col(column).isin(*values)


def row_violations(df: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """All row rules in one narrow pass."""
    broken = F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in rules]))
    one = F.lit(1).cast("bigint")
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("row_key"), one.alias("n_rows"))


def _key_text(keys: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys])


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """Key values held by several rows; a NULL equals nothing."""
    present = df
    for key in keys:
        present = present.filter(F.col(key).isNotNull())
    counts = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
    return counts.select(F.lit("+".join(keys) + ":unique").alias("rule"), _key_text(list(keys)).alias("row_key"), "n_rows")


def _unmatched(df: DataFrame, column: str, allowed: DataFrame, rule: str) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    missing = counts.join(allowed, column, "left_anti")
    return missing.select(F.lit(f"{column}:{rule}").alias("rule"), F.col(column).cast("string").alias("row_key"), "n_rows")


def foreign_key(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return _unmatched(df, column, parent.select(F.col(parent_key).alias(column)), "foreign_key")


def in_catalogue(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Values outside a short fixed list."""
    counts = df.filter(~F.col(column).isin(*values)).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.select(F.lit(f"{column}:catalogue").alias("rule"), F.col(column).alias("row_key"), "n_rows")


def _few(keys: DataFrame) -> DataFrame:
    """Keys of a batch, marked for broadcast if they are counted to be few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_BATCH_KEYS else keys


def unique_in_batch(batch: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """Key values of ``batch`` that several rows of batch and ``stored`` together hold.

    Only keys of the batch are looked up: few of them are broadcast and the stored table is
    filtered where it lies; of more, Spark's runtime filter thins the scan, and a table saved in
    buckets of the key stays where it is. Violations that the stored table has by itself are not
    the batch's and are not listed.
    """
    present = batch
    for key in keys:
        present = present.filter(F.col(key).isNotNull())
    new = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("_new"))
    found = stored.join(_few(new.select(*keys)), list(keys), "left_semi")
    old = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_old"))
    counts = new.join(old, list(keys), "left").withColumn("n_rows", F.col("_new") + F.coalesce("_old", F.lit(0)))
    rule = F.lit("+".join(keys) + ":unique").alias("rule")
    return counts.where("n_rows > 1").select(rule, _key_text(list(keys)).alias("row_key"), "n_rows")


def foreign_key_in_batch(batch: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """References of ``batch`` that the stored parent lacks, by looking up only these."""
    counts = batch.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    known = parent.select(F.col(parent_key).alias(column)).join(_few(counts.select(column)), column, "left_semi").distinct()
    missing = counts.join(known, column, "left_anti")
    return missing.select(F.lit(f"{column}:foreign_key").alias("rule"), F.col(column).cast("string").alias("row_key"), "n_rows")


def all_violations(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
