"""Archives against the rows they were made from, and against a plain parser."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from inductra.llm import common, warc
from inductra.llm.queries import op11_warc

LONG = "ä€😀 WARC/1.0\r\n\r\nContent-Length: 3\r\n" * 400


def rows_of_pages():
    rows = [(i, f"http://x.example/{i}", "same " * 300) for i in range(50)]
    rows += [(100, "http://x/a b\r\nWARC-Type: evil", LONG), (101, None, LONG + "!"), (102, "u", LONG), (102, "u", LONG)]
    rows += [(200, "u", None), (201, "u", ""), (202, "u", "short"), (203, "u", "short"), (None, "u", "same " * 300)]
    rows += [(None, "u", "lone " * 300), (None, "u", "lone " * 300), (300, "u", "é" * 500), (301, "u", "é" * 500)]
    return rows


def expected(rows):
    """(page, bytes, digest, type, refers to) by plain Python."""
    bodies = [(i, (h or "").encode()) for i, _, h in rows]
    top = {}
    for i, body in bodies:
        if i is not None:
            top[body] = max(i, top.get(body, i))
    out = []
    for i, body in bodies:
        revisit = len(body) >= 1000 and body in top and i != top[body]
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top[body] if revisit else None))
    return sorted(out, key=str)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(rows_of_pages(), "page_id bigint, url string, html string").repartition(3)


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("groups", [0, 1000])
def test_round_trip(spark, pages, monkeypatch, tmp_path, compress, groups):
    monkeypatch.setattr(common, "BROADCAST_GROUPS", groups)
    named = pages.withColumns({c: F.lit("kept") for c in ("data", "chunk", "record_type", "payload_bytes", "salt")})
    marked = warc.with_references(named, "page_id", "html")
    files = warc.write(warc.chunk_rows(marked, "page_id", "url", "html", 100), str(tmp_path), compress, file_bytes=10_000)
    assert files.count() > 3
    assert files.agg(F.sum("records")).first()[0] == len(rows_of_pages())
    listed = warc.archives(spark, str(tmp_path))
    assert {warc.place(r.file)[1] for r in listed.collect()} == {r.file for r in files.collect()}
    got = warc.read(listed, chunk_bytes=100).collect()
    assert all(len(r.data) <= 100 for r in got) and max(r.chunk for r in got) > 100
    records = {}
    for r in got:
        records.setdefault((r.file, r.at), []).append(r)
    back = []
    for chunks in records.values():
        chunks.sort(key=lambda r: r.chunk)
        last = chunks[-1]
        assert [c.chunk for c in chunks] == list(range(len(chunks))) and [c for c in chunks if c.last] == [last]
        assert last.valid
        body = b"".join(c.data for c in chunks)
        if last.record_type == "response":
            assert (len(body), hashlib.sha1(body).hexdigest()) == (last.payload_bytes, last.payload_digest)
        else:
            assert body == b""
        number = [None if v is None else int(v) for v in (last.record_id, last.refers_to)]
        back.append((number[0], last.payload_bytes, last.payload_digest, last.record_type, number[1]))
    assert sorted(back, key=str) == expected(rows_of_pages())
    targets = {(r.record_id, r.target) for r in got}
    assert ("101", None) in targets and ("100", "http://x/a%20b%0D%0AWARC-Type:%20evil") in targets
    short = warc.read(files, data=False).collect()
    assert len(short) == len(rows_of_pages()) and all(r.valid for r in short)


def test_archives_of_others(spark, tmp_path):
    """Other block types, folded and unknown headers, base 16 digests, wrong digests, plain and compressed members."""
    body = b"hello\r\n\r\nworld"
    sha = hashlib.sha1(body).hexdigest().upper()

    def record(kind, extra, block):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nwarc-record-id: <urn:uuid:7>\r\n{extra}Content-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nX: 1\r\n y\r\n\r\n"
    blocks = [
        record("warcinfo", "Content-Type: application/warc-fields\r\n", b"software: x\r\n"),
        record("response", f"Content-Type: application/http\r\nWARC-Payload-Digest: sha1:{sha}\r\n", http + body),
        record("resource", "Content-Type: text/plain\r\nWARC-Payload-Digest: sha1:" + "0" * 40 + "\r\n", body),
        record("metadata", "WARC-Payload-Digest: md5:00\r\n", b""),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(blocks))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(b) for b in blocks))
    out = warc.read(warc.archives(spark, str(tmp_path))).collect()
    for suffix in ("a.warc", "b.warc.gz"):
        got = sorted((r for r in out if r.file.endswith(suffix)), key=lambda r: r.at)
        assert [r.record_type for r in got] == ["warcinfo", "response", "resource", "metadata"]
        assert [r.valid for r in got] == [True, True, False, True]
        assert bytes(got[1].data) == body and got[1].payload_digest == sha.lower() and got[1].record_id == "urn:uuid:7"
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "c.warc").write_bytes(blocks[1][:-10])
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read(warc.archives(spark, str(broken))).collect()


def test_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    files = warc.write(warc.chunk_rows(warc.with_references(empty, "page_id", "html"), "page_id", "url", "html"), str(tmp_path))
    assert warc.read(files).collect() == []


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    got = op11_warc(spark, sf_dir)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)
