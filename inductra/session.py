"""Session settings and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "inductra") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.executorEnv.PYTHONPATH", str(Path(__file__).resolve().parents[1]))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-master session without the setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="inductra-")


def run_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one, never reused between runs."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` reliably, so that lost executors cannot change what was read once."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def plain_union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both, partitioned by nothing in particular; ``right`` is the smaller side.

    Where both sides are partitioned by one key, Spark takes the union for partitioned by it
    and adds no exchange to what follows. Adaptive execution may give the sides different
    partition counts later on, so the smaller side is dealt anew here.
    """
    wanted = int(right.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.unionByName(right.repartition(max(2, wanted)))
