"""Streaming forms of the two per-call writes: module progress and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inductra.operators.progress import KEY, module_progress
from inductra.schemas import MODULES
from inductra.streaming.folders import ChangeFolders, IdIndex

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """The events table as a stream; the glob also accepts a folder of part files."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{sf_dir.rstrip('/')}/[e]vents.parquet")


def submissions_of(events: DataFrame) -> DataFrame:
    """Events as module submissions; the module follows from the hour."""
    names = F.array(*[F.lit(m) for m in MODULES])
    return events.select(
        F.col("event_id").alias("submission_id"),
        F.col("user_id").alias("employee_id"),
        F.get(names, F.floor(F.hour("ts") / 2).cast("int")).alias("module_id"),
        F.col("props").alias("answers"),
        (F.col("event_type") == "purchase").alias("completed"),
        F.col("ts").alias("submitted_at"),
    )


def progress_stream(
    submissions: DataFrame, path: str, checkpoint: str, compact_every: int | None = None, **trigger
) -> StreamingQuery:
    """Keep module progress up to date from a stream of submissions.

    Same fold as the batch operator, so the result does not depend on arrival order.
    State is one row per (employee, module), kept without a watermark as any of them may
    change again; a cluster with much staff sets the RocksDB state store. Each micro-batch
    writes only the rows it changed, into a folder named by its id: a replayed batch
    replaces its own folder. Every ``compact_every`` batches the folders are folded into one
    base, so that readers never meet more than so many.
    """
    folders = ChangeFolders(path, KEY)
    first = folders.first_batch(submissions.sparkSession, checkpoint)

    def write_changes(changes: DataFrame, batch_id: int) -> None:
        folders.write(changes, first + batch_id)
        if compact_every and batch_id and batch_id % compact_every == 0:
            folders.compact(changes.sparkSession)

    query = module_progress(submissions).writeStream.outputMode("update").foreachBatch(write_changes)
    return query.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_progress(spark: SparkSession, path: str, stored: DataFrame | None = None) -> DataFrame:
    """The progress table from the newest base and the change folders after it.

    ``stored`` is a progress table from before the stream; its rows stay where the stream has
    none for a key.
    """
    changes = ChangeFolders(path, KEY).read(spark)
    if stored is None or changes is None:
        return stored if changes is None else changes
    columns = [c for c in changes.columns if c not in KEY]
    old = stored.select(*KEY, F.struct(*columns).alias("_old"))
    both = changes.select(*KEY, F.struct(*columns).alias("_new")).join(old, list(KEY), "full")
    return both.select(*KEY, F.coalesce("_new", "_old").alias("_row")).select(*KEY, "_row.*")


def audit_stream(
    entries: DataFrame, path: str, checkpoint: str, buckets: int = 64, compact_every: int = 20, **trigger
) -> StreamingQuery:
    """Append audit entries to a log, each entry id once, whatever day a repeat carries.

    The log has a folder per batch and in it one per day. Ids it has are kept beside it, in an
    index by hash bucket, of which a batch reads the buckets of its own ids. Of repeats within a
    batch the earliest entry is written, of later ones none; entries without an id are all
    written. A batch that is repeated compares itself with earlier batches only and replaces its
    own folders, log and index alike. Index folders are folded every ``compact_every`` batches.
    """
    spark = entries.sparkSession
    index = IdIndex(f"{path.rstrip('/')}_ids", entries.schema["id"].dataType.simpleString(), buckets)
    first = index.first_batch(spark, checkpoint)
    columns = [c for c in entries.columns if c not in ("id", "created_at")]

    def write_new(batch: DataFrame, batch_id: int) -> None:
        number = first + batch_id
        if batch_id and batch_id % compact_every == 0:
            index.compact(batch.sparkSession, number - 1)
        earliest = F.min(F.struct("created_at", *columns)).alias("_row")
        once = batch.where("id IS NOT NULL").groupBy("id").agg(earliest).select("id", "_row.*")
        fresh = index.unknown(once, number).unionByName(batch.where("id IS NULL").select("id", "created_at", *columns))
        fresh = fresh.withColumn("audit_date", F.to_date("created_at")).persist()
        fresh.write.mode("overwrite").partitionBy("audit_date").parquet(f"{path}/batch={number}")
        index.write(fresh.where("id IS NOT NULL"), number)
        fresh.unpersist()

    query = entries.writeStream.foreachBatch(write_new).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()


def audit_entries_of(events: DataFrame) -> DataFrame:
    """Events as audit entries."""
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("target_id"),
        F.col("event_type").alias("action"),
        F.col("props").alias("detail"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
