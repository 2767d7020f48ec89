"""What several operators of this subpackage share: tables, stored steps, text and hash arrays."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inductra.session import run_folder

#: Characters a task works on at once, whatever the size of the Arrow batch it got.
SLICE_CHARS = 1 << 21

#: Words hashed in one go.
WORDS_AT_ONCE = 1 << 13

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table; from here on Python workers look for this package where the driver has it."""
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(spark: SparkSession) -> None:
    """Python workers look for this package where the driver has it.

    On a cluster the package is installed on the executors, and the path is of no effect. Spark
    starts other workers beside the idle ones when their environment changes, so this comes first.
    """
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def store(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to a fresh folder below the shared one and read it back.

    Cuts the lineage: what follows reads files that survive lost executors.
    """
    spark = df.sparkSession
    folder = run_folder(spark, label)
    df.write.parquet(folder, compression=compression)
    out = spark.read.schema(df.schema).parquet(folder)
    out.stored_in = folder
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``store`` wrote and no later step reads, and shuffle files of finished jobs.

    Whatever was made from them must be stored by now.
    """
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_in)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    settle(tables[0].sparkSession)


def settle(spark: SparkSession) -> None:
    """Let executors remove the shuffle files of finished jobs.

    The driver's collector finds which shuffles nobody refers to any more; a large step would
    else keep its files until the collector runs by itself.
    """
    gc.collect()
    spark._jvm.System.gc()


#: Up to so many groups are broadcast, at about 100 bytes each.
BROADCAST_GROUPS = 200_000

#: Parts that the rows of one group are dealt to where groups are joined.
SALTS = 64


def join_groups(df: DataFrame, groups: DataFrame, key: str, spread: Column) -> DataFrame:
    """Left join of ``df`` with stored ``groups``, unique by ``key``, without ``key``.

    Few groups are broadcast. Else rows meet their group per (key, salt), the salt taken from
    ``spread``, so a group of very many rows is dealt to ``SALTS`` tasks; rows with a null key
    have no group and are dealt by ``spread`` alone.
    """
    if groups.count() <= BROADCAST_GROUPS:
        return df.join(F.broadcast(groups), key, "left").drop(key)
    salt = F.when(F.col(key).isNull(), spread).otherwise(F.pmod(spread, F.lit(SALTS)))
    salted = df.withColumn("__salt", salt)
    spots = salted.where(F.col(key).isNotNull()).select(key, "__salt").distinct().join(groups, key)
    return salted.join(spots, [key, "__salt"], "left").drop(key, "__salt")


#: The C library's way to return freed memory, where it has one.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy() -> None:
    """Give memory that a Python worker no longer uses back; workers live on through later stages."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def crc_of_id(id_col: Column) -> Column:
    """crc32 of an id written as text; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``limit`` characters; one longer text is a run of its own."""
    start, size, run = 0, 0, []
    for i, text in enumerate(texts):
        text = text or ""
        if run and size + len(text) > limit:
            yield start, run
            start, size, run = i, 0, []
        run.append(text)
        size += len(text)
    if run:
        yield start, run


def row_slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(first, last) row of runs of texts of about ``limit`` bytes, at least one row each."""
    _, offsets = utf8(texts)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield start, end
        start = end


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets; null is an empty text."""
    array = array.cast(pa.large_string()).fill_null("")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return raw, at - at[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1, one run after the other.

    They are summed up from steps in place, so that no second array of that length is made.
    """
    some = lengths > 0
    starts, lengths = starts[some].astype(np.int64), lengths[some].astype(np.int64)
    ends = np.cumsum(lengths)
    if len(ends) == 0:
        return np.zeros(0, np.int64)
    out = np.ones(ends[-1], np.int64)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out, out=out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes, in place where possible."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased; all other bytes stay."""
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


#: Bytes that end a word: blank and the five control characters from tab to carriage return.
WORD_GAP = np.zeros(256, bool)
WORD_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of the words between gaps; no word crosses two texts."""
    inside = ~WORD_GAP[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, by an odd-base polynomial and a final mix.

    Ranges are hashed in groups that stay in the processor's cache.
    """
    out = np.zeros(len(start), np.uint64)
    length = end - start
    if len(start) == 0:
        return out
    powers = np.cumprod(np.full(int(length.max()), GOLDEN, np.uint64), dtype=np.uint64)
    for i in range(0, len(start), WORDS_AT_ONCE):
        sizes = length[i : i + WORDS_AT_ONCE]
        begins = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(begins, sizes)
        terms = raw[place + np.repeat(start[i : i + WORDS_AT_ONCE], sizes)].astype(np.uint64)
        terms += np.uint64(1)
        terms *= powers[place]
        out[i : i + WORDS_AT_ONCE] = np.add.reduceat(terms, begins) + sizes.astype(np.uint64)
    return mix(out)


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    """A list array of consecutive runs of ``values``."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)
