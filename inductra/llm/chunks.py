"""Texts in chunks, and questions that chunks ask of shards.

A chunk is one stored row with the ids and texts of a few megabytes of documents. An operator
reduces each chunk to short arrays per shard of a hash space; the shards see the arrays of all
chunks and answer per chunk; the answers are joined back to the stored chunks. A value that
occurs in very many documents is one entry per chunk, so no shard grows with its copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from inductra.llm.common import store, tidy, utf8

#: Bytes of text in a chunk, about; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20

#: Bytes of all texts for each shard of the hash space.
SHARD_BYTES = 8 << 20
MAX_SHARD_BITS = 16

#: Bits of a hash, besides its shard's, by which chunks find shared ones.
SENT_BITS = 28

NO_ID = np.iinfo(np.int64).max

Chunk = tuple[int, np.ndarray, np.ndarray, np.ndarray]  # number, ids, bytes, offsets


def chunk_table(df: DataFrame, text: str, row_id: str, rest: list[str] | None = None) -> DataFrame:
    """Store (chunk, n_bytes, ids, lengths, data): ``data`` are the compressed texts in a row.

    A missing text is empty, a missing id stays missing. With ``rest``, a column of that name
    has a list of structs, the rows' values of these columns.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, (raw, offsets) = batch.column(0), utf8(batch.column(1))
            start = 0
            while start < len(ids):
                end = int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, side="right")) - 1
                end = min(max(end, start + 1), len(ids))
                data = raw[offsets[start] : offsets[end]]
                size = pa.array([0, end - start], pa.int32())
                lengths = pa.array(np.diff(offsets[start : end + 1]), pa.int64())
                others = [c.slice(start, end - start) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([len(data)], pa.int64()),
                        pa.ListArray.from_arrays(size, ids.slice(start, end - start)),
                        pa.ListArray.from_arrays(size, lengths),
                        pa.array([packed(data)], pa.binary()),
                        *(pa.ListArray.from_arrays(size, c) for c in others),
                    ],
                    schema.names,
                )
                number += 1
                start = end
            tidy()

    more = [F.struct(*rest).alias("rest")] if rest else []
    rows = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(text).alias("text"), *more)
    schema = StructType.fromDDL("chunk bigint, n_bytes bigint, ids array<bigint>, lengths array<bigint>, data binary")
    if rest:
        schema = schema.add("rest", ArrayType(rows.schema["rest"].dataType))
    return store(rows.mapInArrow(pack, schema), "chunks")


def packed(data: np.ndarray) -> bytes:
    return pa.compress(data.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def shard_bits(chunks: DataFrame) -> int:
    """Bits of a hash that name its shard, from the size of all texts."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return min(MAX_SHARD_BITS, max(1, int(total // SHARD_BYTES).bit_length()))


def open_chunk(batch: pa.RecordBatch, row: int) -> Chunk:
    ids = batch.column("ids")[row].values.fill_null(NO_ID).to_numpy(zero_copy_only=False)
    raw = unpacked(batch.column("data")[row].as_py(), batch.column("n_bytes")[row].as_py())
    lengths = batch.column("lengths")[row].values.to_numpy(zero_copy_only=False)
    return batch.column("chunk")[row].as_py(), ids, raw, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def each_chunk(chunks: DataFrame, work: Callable[[Chunk], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``work`` makes of every chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                yield from work(open_chunk(batch, row))
                tidy()

    return chunks.drop("rest").mapInArrow(run, schema)


def each_answered(
    chunks: DataFrame,
    answers: DataFrame,
    work: Callable[[Chunk, dict[int, tuple]], Iterable[pa.RecordBatch]],
    schema: str,
    rest: bool = False,
) -> DataFrame:
    """The same with the answers of the shards: shard -> values of the answer's other columns.

    With ``rest``, ``work`` makes one row of each text of a chunk, and they get the struct that
    ``chunk_table`` put aside for them. Else that column is not read.
    """
    chunks = chunks if rest else chunks.drop("rest")
    columns = [c for c in answers.columns if c not in ("chunk", "shard")]
    listed = answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", *columns)).alias("answers"))
    joined = chunks.join(listed, "chunk", "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                found = batch.column("answers")[row].as_py() or []
                for out in work(open_chunk(batch, row), {a["shard"]: tuple(a[c] for c in columns) for a in found}):
                    yield out.append_column("rest", batch.column("rest")[row].values) if rest else out
                tidy()

    made = StructType.fromDDL(schema)
    return joined.mapInArrow(run, made.add("rest", chunks.schema["rest"].dataType.elementType) if rest else made)


def by_shard(
    asked: DataFrame, work: Callable[[int, pa.Table], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """What ``work`` makes of all rows of a shard."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(key[0].as_py(), pa.Table.from_batches(list(batches)))
        tidy()

    return asked.groupBy("shard").applyInArrow(run, schema)


def split_by_shard(hashes: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """Shards of sorted hashes (their leading bits), each with the slice of its hashes."""
    shard = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
    return [(int(shard[a]), slice(int(a), int(b))) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


# Which hashes of a chunk occur under more than one owner


def distinct_owners(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and whether each has more than one owner here."""
    if len(hashes) == 0:
        return hashes, np.zeros(0, bool)
    order = np.argsort(hashes, kind="stable")
    ranked, owner = hashes[order], owners[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    several = np.minimum.reduceat(owner, head) < np.maximum.reduceat(owner, head)
    return ranked[head], several


def shared_flags(
    chunks: DataFrame, bits: int, hashes_of: Callable[[Chunk], tuple[np.ndarray, np.ndarray]]
) -> DataFrame:
    """(chunk, shard, shared): bits for the sorted distinct hashes of the chunk in the shard.

    A bit is set if the hash has several owners in the chunk or occurs in another chunk. Only
    ``SENT_BITS`` of a hash below the shard's are sent: a few flags may be set without need,
    none is missing.
    """

    def ask(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        hashes, several = distinct_owners(*hashes_of(chunk))
        rows = [
            (shard, at.stop - at.start, rising(short_form(hashes[at], bits)), np.packbits(several[at]).tobytes())
            for shard, at in split_by_shard(hashes, bits)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([chunk[0]] * len(rows), pa.int64()),
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.binary()),
                pa.array([r[3] for r in rows], pa.binary()),
            ],
            ["chunk", "shard", "size", "hashes", "several"],
        )

    def answer(shard: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes = rows.column("size").to_numpy().astype(np.int64)
        parts = [risen(v.as_py(), n) for v, n in zip(rows.column("hashes"), sizes.tolist())]
        flags = [
            np.unpackbits(np.frombuffer(v.as_py(), np.uint8), count=n).astype(bool)
            for v, n in zip(rows.column("several"), sizes.tolist())
        ]
        values, shared = np.concatenate(parts), np.concatenate(flags)
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        again = ranked[1:] == ranked[:-1]
        twice = np.concatenate([again, [False]]) | np.concatenate([[False], again])
        shared[order[twice]] = True
        ends = np.cumsum(sizes)
        found = [np.packbits(shared[e - n : e]).tobytes() for n, e in zip(sizes.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("chunk").combine_chunks(),
                pa.array([shard] * len(found), pa.int32()),
                pa.array(found, pa.binary()),
            ],
            ["chunk", "shard", "shared"],
        )

    asked = each_chunk(chunks, ask, "chunk bigint, shard int, size int, hashes binary, several binary")
    return by_shard(asked, answer, "chunk bigint, shard int, shared binary")


def short_form(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The ``SENT_BITS`` below the shard's."""
    return ((hashes << np.uint64(bits)) >> np.uint64(64 - SENT_BITS)).astype(np.uint32)


def rising(values: np.ndarray) -> bytes:
    """Sorted numbers as compressed steps, byte by byte of the steps."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return packed(steps.view(np.uint8).reshape(-1, 4).T)


def risen(data: bytes, size: int) -> np.ndarray:
    planes = unpacked(data, size * 4).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def shared_hashes(hashes: np.ndarray, bits: int, answers: dict[int, tuple]) -> np.ndarray:
    """The shared ones of a chunk's hashes, sorted; ``answers`` as ``shared_flags`` gave them."""
    distinct = np.unique(hashes)
    kept = [
        distinct[at][np.unpackbits(np.frombuffer(answers[shard][0], np.uint8), count=at.stop - at.start).astype(bool)]
        for shard, at in split_by_shard(distinct, bits)
        if shard in answers
    ]
    return np.concatenate(kept) if kept else distinct[:0]


def is_in(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if len(ranked) == 0:
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)
    return ranked[at] == values
