"""Reading and writing the tables of the data model."""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inductra.functions.replies import reply_text
from inductra.functions.text import trim_all
from inductra.schemas import AUDIT_LOGS, EMPLOYEES, MODULE_PROGRESS, MODULES, USERS

SCHEMAS = {
    "employees": EMPLOYEES,
    "module_progress": MODULE_PROGRESS,
    "audit_logs": AUDIT_LOGS,
    "users": USERS,
}

_PRODUCT = "name: string, category: string, description: string, reject_note: string, keywords: string"
REQUEST_BODY = f"""
    request_id bigint, question string, staffPhoto string,
    referenceGoodUrl string, referenceRejectUrl string, textOnlyMode boolean,
    product struct<{_PRODUCT}>, products array<struct<{_PRODUCT}>>,
    candidates array<struct<id: bigint, name: string, category: string>>
"""


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One of the core tables, with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def catalogue(spark: SparkSession) -> DataFrame:
    """The twelve modules; a literal table of fixed size."""
    return spark.createDataFrame(list(enumerate(MODULES)), "idx int, module_id string")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request bodies, one JSON object per line; absent fields are NULL."""
    body = spark.read.schema(REQUEST_BODY).json(path)
    names = {
        "staffPhoto": "staff_photo", "referenceGoodUrl": "good_url",
        "referenceRejectUrl": "reject_url", "textOnlyMode": "text_only",
    }
    return body.withColumnsRenamed(names).withColumns(
        {
            "product_name": F.col("product.name"),
            "n_candidates": F.coalesce(F.size("candidates"), F.lit(0)),
        }
    )


def with_reply_text(responses: DataFrame, body: str = "body") -> DataFrame:
    """Add the trimmed reply text of each raw response body."""
    return responses.withColumn("reply_text", trim_all(F.coalesce(reply_text(body), F.lit(""))))


def append_audit(entries: DataFrame, path: str, run_id: str) -> None:
    """Append to the log, one folder per run and in it one per day.

    A run that is repeated after a failure replaces its own folder as a whole, so days it no
    longer has do not stay behind and nothing is added twice. The rebalance hint lets AQE
    size the files and split a day that holds most entries.
    """
    dated = entries.withColumn("audit_date", F.to_date("created_at"))
    writer = dated.hint("rebalance", "audit_date").write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy("audit_date").parquet(f"{path}/run_id={run_id}")


def save_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> None:
    """Store a table in buckets of ``key``, at ``path``.

    Employees and their progress, bucketed alike by employee, are joined and folded
    without a shuffle; choose ``buckets`` so that one bucket fits a task.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).saveAsTable(table)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Write a one-column JSON table as text; ordered input keeps its order across files."""
    df.select("value").write.mode("errorifexists").text(path)


POINTER = "version bigint, run_id string, written_at timestamp_ntz"


class VersionConflict(Exception):
    """Another writer has published a version since the one that was expected."""


def _claim(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file that must not exist yet; whether this call was the one that did."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getUri().getScheme() == "file":
        # The local file system of that library looks first and creates then.
        try:
            handle = os.open(system.makeQualified(place).toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(content)
        return True
    try:
        out = system.create(place, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(content, "utf-8"))
    out.close()
    return True


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(POINTER).json(f"{root}/pointer")


def write_snapshot(df: DataFrame, root: str, run_id: str, run_ts: Column, expected: int | None = None) -> int:
    """Write a new version of a table, then point at it; its version number.

    Files are never changed in place, so ``df`` may read the version it replaces. Once all data
    is written, the version takes the next number by creating that number's own pointer file,
    which only one writer can do: of two at once the other takes the number behind, and both
    versions stay readable. With ``expected``, the number of the version ``df`` was made from, a
    version that came in between raises ``VersionConflict`` instead, and the caller starts over.
    A writer that dies on the way leaves data or a number that nobody refers to.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointer")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    df.write.mode("errorifexists").parquet(f"{root}/version={run_id}")
    row = spark.range(1).select(F.lit(run_id).alias("run_id"), run_ts.cast("timestamp_ntz").alias("written_at"))
    number = (_pointers(spark, root).agg(F.max("version")).first()[0] or 0) + 1 if expected is None else expected + 1
    while True:
        numbered = row.select(F.to_json(F.struct(F.lit(number).cast("bigint").alias("version"), "run_id", "written_at")))
        if _claim(spark, f"{root}/pointer/version-{number:012d}.json", numbered.first()[0] + "\n"):
            return number
        if expected is not None:
            raise VersionConflict(f"{root}: version {number} is taken")
        number += 1


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version by its number, or the newest one."""
    pointers = _pointers(spark, root)
    if version is not None:
        pointers = pointers.where(F.col("version") == version)
    newest = pointers.agg(F.max_by("run_id", F.struct("version", "written_at", "run_id")).alias("run_id")).first()
    return spark.read.parquet(f"{root}/version={newest['run_id']}")
