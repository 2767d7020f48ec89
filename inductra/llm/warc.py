"""WARC archives as tables of chunks.

A record's payload travels as rows (record, chunk number, bytes) of at most ``CHUNK_BYTES``, on
the way into archives and out of them. Writers and readers stream from row to row: a payload is
never in memory as a whole, its digest is carried from chunk to chunk, and archives are parsed by
the lengths in their headers, so bytes that look like headers do no harm.

Each task writes archives of its own, under names no other attempt uses, and hands back their
names; the stored list of these counts, so a task that ran twice leaves nothing twice.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inductra.llm.common import join_groups, store, tidy

#: Payload bytes in one row.
CHUNK_BYTES = 1 << 18

#: A task starts a new archive once one has so many bytes before compression.
FILE_BYTES = 256 << 20

#: Payloads shorter than this are not worth a reference.
LEAST_SHARED = 1000

#: Longest header line that is read.
LINE_BYTES = 1 << 20

#: Chunk rows sent on in one batch hold about so many payload bytes.
BATCH_BYTES = 8 << 20

PREFIX = "urn:record:"
MANIFEST = "file string, records bigint, bytes bigint"
CHUNKS = """file string, at bigint, record_id string, record_type string, target string, refers_to string,
    chunk bigint, last boolean, payload_bytes bigint, payload_digest string, valid boolean, data binary"""


def payload_of(column: Column) -> Column:
    """Text or bytes as bytes; null is empty."""
    return F.coalesce(column.cast("binary"), F.lit("").cast("binary"))


def with_references(df: DataFrame, row_id: str, payload: str, least: int = LEAST_SHARED) -> DataFrame:
    """``df`` with record_type, refers_to, payload_bytes and payload_digest (SHA-1, hex).

    Of rows with equal payloads of at least ``least`` bytes, the one with the largest id is a
    response and the others are revisits that refer to it; a missing id counts as smallest.
    Rows that repeat the largest id are responses all, and so are all rows of a group without
    any id. Shorter payloads are responses, a null one is empty. Columns of ``df`` with one of
    the new names are replaced.

    The largest id per payload is pre-aggregated. Groups of several rows are broadcast if
    they are few; else rows and groups meet per (payload, salt), so a payload that very many
    rows share is spread.
    """
    body = payload_of(F.col(payload))
    key = F.when(F.octet_length(body) >= least, F.sha2(body, 256))
    keyed = df.withColumn("__key", key)
    groups = keyed.where("__key IS NOT NULL").groupBy("__key")
    groups = groups.agg(F.max(row_id).alias("__top"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    groups = store(groups.select("__key", "__top", F.lit(True).alias("__several")), "warc-groups")
    joined = join_groups(keyed, groups, "__key", F.xxhash64(row_id))
    revisit = F.coalesce(F.col("__several"), F.lit(False)) & ~F.col(row_id).eqNullSafe(F.col("__top"))
    made = joined.withColumns(
        {
            "record_type": F.when(revisit, "revisit").otherwise("response"),
            "refers_to": F.when(revisit, F.col("__top")),
            "payload_bytes": F.octet_length(body).cast("bigint"),
            "payload_digest": F.sha1(body),
        }
    )
    return made.drop("__top", "__several")


def chunk_rows(
    df: DataFrame, row_id: str, target: str | None, payload: str, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """One row per chunk of every record, in order; a revisit and an empty payload have one without bytes.

    ``df`` has the columns of ``with_references``.
    """
    text = F.lit("").cast("binary")
    body = F.when(F.col("record_type") == "revisit", text).otherwise(payload_of(F.col(payload)))
    chunks = F.expr(
        f"transform(sequence(0L, greatest((octet_length(__body) - 1) div {chunk_bytes}, 0L)),"
        f" k -> substring(__body, CAST(k * {chunk_bytes} + 1 AS INT), {chunk_bytes}))"
    )
    rows = df.select(
        F.col(row_id).cast("string").alias("record_id"),
        "record_type",
        (F.col(target) if target else F.lit(None)).cast("string").alias("target"),
        F.col("refers_to").cast("string").alias("refers_to"),
        "payload_bytes",
        "payload_digest",
        body.alias("__body"),
    )
    return rows.select("*", F.posexplode(chunks).alias("chunk", "data")).drop("__body")


def place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder or file, for Python workers."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), parts.path
    return pyarrow.fs.FileSystem.from_uri(uri)


def _named(value: str | None) -> str:
    return f"<{PREFIX}{quote(value or '', safe='')}>"


def _unnamed(value: str | None) -> str | None:
    if value is None:
        return None
    value = value.strip("<>")
    return (unquote(value[len(PREFIX) :]) if value.startswith(PREFIX) else value) or None


def _uri(value: str) -> str:
    """A target on one line: white space and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", value)


def _hex_digest(value: str | None) -> str | None:
    """SHA-1 in hex from a labelled digest in hex or base 32; None if it is another digest."""
    label, _, digest = (value or "").partition(":")
    if label.lower() != "sha1":
        return None
    if len(digest) == 32:
        return base64.b32decode(digest.upper()).hex()
    return digest.lower()


def _headers(row: dict, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    length = len(http) + (0 if row["record_type"] == "revisit" else row["payload_bytes"])
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    lines = ["WARC/1.0", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_named(row['record_id'])}"]
    lines += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if row["target"] is not None:
        lines.append(f"WARC-Target-URI: {_uri(row['target'])}")
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_named(row['refers_to'])}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}", "", http]
    return "\r\n".join(lines).encode()


class Archive:
    """One archive being written; it has its name only once it is whole."""

    def __init__(self, folder: str, compress: bool):
        self.system, path = place(folder)
        name = f"{uuid.uuid4().hex}.warc" + (".gz" if compress else "")
        self.hidden, self.path = f"{path}/.{name}", f"{path}/{name}"
        self.raw = self.system.open_output_stream(self.hidden, compression=None)
        self.compress, self.out = compress, None
        self.records = self.bytes = 0

    def begin(self, header: bytes) -> None:
        """A record is a compressed member of its own, so that one can be read without the others."""
        self.out = gzip.GzipFile(fileobj=self.raw, mode="wb", compresslevel=1, mtime=0) if self.compress else self.raw
        self.records += 1
        self.add(header)

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def end(self) -> None:
        self.add(b"\r\n\r\n")
        if self.compress:
            self.out.close()

    def close(self) -> dict:
        self.raw.close()
        self.system.move(self.hidden, self.path)
        return {"file": self.path, "records": self.records, "bytes": self.bytes}


def write(
    chunks: DataFrame,
    folder: str,
    compress: bool = True,
    date: str = "2000-01-01T00:00:00Z",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the records of ``chunk_rows`` into archives below ``folder``; (file, records, bytes).

    The order of rows within a partition counts and must not change in between. The result is
    stored, so archives are written once; an empty table writes none.
    """
    system, path = place(folder)
    system.create_dir(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, left, seen, done = None, 0, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] == 0:
                    if archive is not None and archive.bytes >= file_bytes:
                        done.append(archive.close())
                        archive = None
                    archive = archive or Archive(folder, compress)
                    archive.begin(_headers(row, date))
                    left = 0 if row["record_type"] == "revisit" else row["payload_bytes"]
                    seen = hashlib.sha1()
                archive.add(row["data"])
                seen.update(row["data"])
                left -= len(row["data"])
                if left == 0:
                    if row["record_type"] != "revisit" and seen.hexdigest() != row["payload_digest"]:
                        raise ValueError(f"record {row['record_id']}: chunks do not make up the payload")
                    archive.end()
            tidy()
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return store(chunks.mapInArrow(run, MANIFEST), "warc-files")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of all archives below a folder, as the file system lists them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true")
    return found.load(folder).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


class Source:
    """A stream of archive bytes with its position."""

    def __init__(self, file: str):
        system, path = place(file)
        raw = system.open_input_stream(path, compression=None)
        self.stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, CHUNK_BYTES)
        self.file, self.at = file, 0

    def line(self) -> bytes:
        line = self.stream.readline(LINE_BYTES)
        self.at += len(line)
        return line

    def take(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.at += len(data)
        if len(data) < n:
            raise ValueError(f"{self.file}: ends inside a record")
        return data

    def fields(self) -> tuple[dict[str, str], int]:
        """Header fields up to the empty line, names in lower case, and the bytes read."""
        start, found, last = self.at, {}, None
        while True:
            line = self.line()
            if line in (b"\r\n", b"\n"):
                return found, self.at - start
            if not line.endswith(b"\n"):
                raise ValueError(f"{self.file}: header without end at byte {start}")
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if last and text[:1] in (" ", "\t"):
                found[last] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            last = name.strip().lower()
            found[last] = value.strip()


def records(file: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """The chunks of all records of one archive, in order, with ``data``."""
    source = Source(file)
    while True:
        at, line = source.at, source.line()
        while line in (b"\r\n", b"\n"):
            at, line = source.at, source.line()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{file}: no record at byte {at}")
        fields, _ = source.fields()
        left = int(fields["content-length"])
        base = {
            "file": file,
            "at": at,
            "record_id": _unnamed(fields.get("warc-record-id")),
            "record_type": fields.get("warc-type"),
            "target": fields.get("warc-target-uri"),
            "refers_to": _unnamed(fields.get("warc-refers-to")),
        }
        http = {}
        if fields.get("content-type", "").startswith("application/http") and left:
            status = source.line()
            http, size = source.fields()
            left -= len(status) + size
        stated = _hex_digest(fields.get("warc-payload-digest"))
        total, digest, chunk = left, hashlib.sha1(), 0
        while True:
            data = source.take(min(left, chunk_bytes))
            digest.update(data)
            left -= len(data)
            row = {**base, "chunk": chunk, "last": left == 0, "data": data}
            if left == 0:
                if fields.get("warc-type") == "revisit" and not total:
                    row |= {"payload_bytes": int(http.get("content-length", 0)), "payload_digest": stated, "valid": True}
                else:
                    found = digest.hexdigest()
                    row |= {"payload_bytes": total, "payload_digest": found, "valid": stated in (None, found)}
            yield row
            chunk += 1
            if left == 0:
                break


def read(files: DataFrame, data: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of all records of the archives named in column ``file``.

    Columns as in ``CHUNKS``: the place of the record, its header, chunk number and bytes; on a
    record's ``last`` chunk also the length and SHA-1 of the whole payload, added up on the way,
    and whether the digest in the header agrees. A revisit carries those of the payload it refers
    to, as its headers state them. ``data=False`` leaves out the bytes and all chunks but the last.
    Archives may be plain or compressed, with HTTP messages or other blocks; a broken archive
    raises. Archives are dealt one by one; each is streamed by one task.
    """
    schema = StructType.fromDDL(CHUNKS if data else CHUNKS.replace(", data binary", ""))
    names = schema.fieldNames()

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        types = [kinds.get(f.dataType.simpleString(), pa.string()) for f in schema.fields]
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, size = [], 0
                for row in records(file, chunk_bytes):
                    if not data:
                        if not row["last"]:
                            continue
                        row.pop("data")
                    rows.append(row)
                    size += 500 + len(row.get("data", b""))
                    if size >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)
            tidy()

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").repartition(n).mapInArrow(run, schema)
