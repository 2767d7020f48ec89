"""Tables kept as change folders, one per micro-batch, with compaction.

A change row is a key's complete new row, so of each key the row of the last batch counts. The
layout is ``batch=<n>`` for changes and ``base=<n>`` for the fold of all batches up to n. A base
counts once its success marker is there; folders it covers are ignored from then on, and removed
one compaction later, so that a reader who has just listed them can finish.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ChangeFolders:
    """A keyed table below ``path``; files read stay constant however many batches there were."""

    def __init__(self, path: str, keys: tuple[str, ...]):
        self.path, self.keys = path.rstrip("/"), tuple(keys)

    def write(self, changes: DataFrame, batch_id: int) -> None:
        """The changes of a batch; a batch that is repeated replaces its own folder."""
        self._store(changes, f"batch={batch_id}")

    def _store(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def first_batch(self, spark: SparkSession, checkpoint: str) -> int:
        """The number of a stream's batch 0: behind all folders when the stream began.

        A stream that goes on from its checkpoint finds its number again; one with a new checkpoint
        does not overwrite what others wrote.
        """
        digest = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_streams")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in system.listStatus(path) if system.exists(path) else ():
            name, _, first = status.getPath().getName().partition("=")
            if name == digest:
                return int(first)
        found = self.listed(spark)
        first = max([*found["base"], *found["batch"], -1]) + 1
        system.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path, f"{digest}={first}"))
        return first

    def listed(self, spark: SparkSession) -> dict[str, list[int]]:
        """Numbers of complete folders by kind; one without a success marker is still being written."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found: dict[str, list[int]] = {"base": [], "batch": []}
        if system.exists(path):
            for status in system.listStatus(path):
                kind, _, number = status.getPath().getName().partition("=")
                marker = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
                if kind in found and number.isdigit() and system.exists(marker):
                    found[kind].append(int(number))
        return {kind: sorted(numbers) for kind, numbers in found.items()}

    def live(self, spark: SparkSession) -> tuple[int | None, list[int]]:
        """The newest base, and the batches after it."""
        found = self.listed(spark)
        base = found["base"][-1] if found["base"] else None
        return base, [n for n in found["batch"] if base is None or n > base]

    def read(self, spark: SparkSession, upto: int | None = None) -> DataFrame | None:
        """One row per key, or None while nothing was written; ``upto`` leaves out later batches."""
        base, batches = self.live(spark)
        wanted = [n for n in batches if upto is None or n <= upto]
        parts = []
        if base is not None:
            parts.append(spark.read.parquet(f"{self.path}/base={base}").withColumn("_batch", F.lit(base)))
        if wanted:
            changes = spark.read.option("basePath", self.path).parquet(*[f"{self.path}/batch={n}" for n in wanted])
            parts.append(changes.withColumnRenamed("batch", "_batch"))
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        kept = [c for c in rows.columns if c not in (*self.keys, "_batch")]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*kept), "_batch").alias("_row"))
        return last.select(*self.keys, *[F.col("_row")[c].alias(c) for c in kept])

    def compact(self, spark: SparkSession, upto: int | None = None) -> int | None:
        """Fold complete batches (up to ``upto``) into a new base; its number, or None if there was nothing new.

        Repeating a compaction that failed writes the same base again. Only the writer of the
        changes, or one process beside it, may compact.
        """
        base, batches = self.live(spark)
        self._retire(spark, base)
        batches = [n for n in batches if upto is None or n <= upto]
        if not batches:
            return None
        self._store(self.read(spark, batches[-1]), f"base={batches[-1]}")
        return batches[-1]

    def _retire(self, spark: SparkSession, base: int | None) -> None:
        """Remove what the last finished base already covered."""
        if base is None:
            return
        found = self.listed(spark)
        old = [f"batch={n}" for n in found["batch"] if n <= base] + [f"base={n}" for n in found["base"] if n < base]
        for name in old:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class IdIndex(ChangeFolders):
    """The ids a log has, in buckets of their hash.

    A batch reads only its own buckets. Each file is sorted by id and has a Bloom filter per row
    group; the few ids of a small batch are pushed into the scan, which then skips what cannot hold
    them. The exact check is an anti-join behind it.
    """

    #: Up to so many ids of a batch are pushed into the scan.
    PUSHED_IDS = 1000

    def __init__(self, path: str, id_type: str, buckets: int = 64):
        super().__init__(path, ("id",))
        self.schema, self.buckets = f"id {id_type}, bucket int", buckets

    def bucket(self, row_id: str = "id") -> Column:
        return F.pmod(F.xxhash64(row_id), F.lit(self.buckets)).cast("int")

    def _store(self, rows: DataFrame, name: str) -> None:
        ids = rows.select("id", self.bucket().alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "id")
        writer = ids.write.mode("overwrite").option("parquet.bloom.filter.enabled#id", "true").partitionBy("bucket")
        writer.parquet(f"{self.path}/{name}")

    def read(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        base, batches = self.live(spark)
        names = [f"batch={n}" for n in batches if upto is None or n <= upto]
        names += [f"base={base}"] if base is not None else []
        if not names:
            return spark.createDataFrame([], self.schema)
        parts = [spark.read.schema(self.schema).parquet(f"{self.path}/{n}") for n in names]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def unknown(self, rows: DataFrame, before: int) -> DataFrame:
        """Rows whose id no batch before ``before`` has; rows without an id are all unknown.

        ``rows`` has one row per id and is small enough to be read twice.
        """
        spark = rows.sparkSession
        ids = rows.where("id IS NOT NULL").select("id", self.bucket().alias("bucket"))
        wanted = [r["bucket"] for r in ids.select("bucket").distinct().collect()]
        known = self.read(spark, before - 1).where(F.col("bucket").isin(wanted))
        few = [r["id"] for r in ids.select("id").limit(self.PUSHED_IDS + 1).collect()]
        if len(few) <= self.PUSHED_IDS:
            spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(self.PUSHED_IDS))
            known = known.where(F.col("id").isin(few))
        return rows.join(known.select(F.col("id").alias("_known")), F.col("id") == F.col("_known"), "left_anti")
