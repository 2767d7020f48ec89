"""Anchors, fingerprints and edited texts against a plain version."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from inductra.llm import fingerprints as fp
from inductra.llm.queries import op4_fingerprints


def hashes(spark, strings):
    df = spark.createDataFrame([(bytearray(s),) for s in set(strings)], "b binary")
    return {bytes(r.b): r.h for r in df.select("b", F.xxhash64("b").alias("h")).collect()}


def plain_anchors(raw, h):
    out = []
    for i in range(len(raw) - fp.K + 1):
        inner = [h[raw[j : j + fp.S]] for j in range(i, i + fp.INNER)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((h[raw[i : i + fp.K]] & 0xFFFFFFFF, i))
    return out


def substrings(raw):
    return [raw[i : i + n] for n in (fp.S, fp.K) for i in range(len(raw) - n + 1)] + [raw]


def plain_print(raw, h):
    found = plain_anchors(raw, h)
    if not found and raw:
        found = [(h[raw] & 0xFFFFFFFF, 0)]
    first = {}
    for x, p in found:
        first.setdefault(x, p)
    return ",".join(f"{x:08x}:{p}" for x, p in sorted(first.items())[: fp.KEPT])


def plain_edits(rows):
    ordered = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], ), reverse=True)
    out = []
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        moved = len(text) // 3
        out.append((i, text, text[: len(text) - moved] + after[:moved]))
    return out


def some_rows(n=30):
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefghijklmnop éß漢😀") for _ in range(n))
    rows = [(i * 3, say(rng.choice([0, 1, 2, 5, 23, 24, 40, 200, 700]))) for i in range(n)]
    return rows + [(100, None), (101, ""), (102, "same same " * 60), (103, "same same " * 60), (None, say(90)), (104, "x" * 3000)]


@pytest.mark.parametrize("slice_bytes", [16 << 20, 800])
def test_against_plain(spark, texts, clashing, monkeypatch, slice_bytes):
    monkeypatch.setattr(fp, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(fp, "WINDOW", 97)
    rows = some_rows()
    edits = plain_edits(rows)
    h = hashes(spark, [s for _, a, b in edits for t in (a, b) for s in substrings(t.encode())])
    got = {r.doc_id: r for r in fp.compare_with_edits(clashing(texts(rows))).collect()}
    assert len(got) == len(rows)
    for i, text, edited in edits:
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == sha256(edited.encode()).hexdigest()
        assert r.fingerprint == plain_print(text.encode(), h)
        assert r.edited_fingerprint == plain_print(edited.encode(), h)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == edited:
            assert r.near_edited == 1


def test_ends_of_the_order(texts):
    assert fp.compare_with_edits(texts([])).collect() == []
    alone = fp.compare_with_edits(texts([(1, "abcdef")])).first()
    assert alone.edited_sha256 == sha256(b"abcdab").hexdigest() and alone.near_next == 1


def test_repeated_ids_are_each_returned(texts):
    rows = [(1, "one text"), (1, "one text"), (1, "another"), (2, "b"), (None, "n"), (None, "m")]
    out = fp.compare_with_edits(texts(rows)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in rows)


def test_shifted_copies_are_alike(spark):
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    df = spark.createDataFrame([(body, "some words first " + body, body[::-1])], "a string, b string, c string")
    for c in "abc":
        df = df.withColumn(f"raw{c}", F.col(c).cast("binary")).withColumn(c, fp.smallest_of(f"raw{c}"))
    row = df.select(fp.likeness("a", "b").alias("shifted"), fp.likeness("a", "c").alias("other")).first()
    assert row.shifted > 0.9 and row.other < 0.1


def test_blocks_match_with_shifts_of_their_own(spark):
    rng = random.Random(2)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    body = say(12_000)
    inserted = body[:6_000] + say(500) + body[6_000:]
    swapped = body[6_000:] + body[:6_000]
    passage = say(300)  # about 50 words
    one, two = (say(60_000) + passage + say(60_000) for _ in "ab")
    df = spark.createDataFrame([(body, inserted, swapped, one, two, say(120_300))], "a string, b string, c string, d string, e string, f string")
    for c in "abcdef":
        df = df.withColumn(f"raw{c}", F.col(c).cast("binary")).withColumn(c, fp.smallest_of(f"raw{c}"))
    pairs = {"inserted": "ab", "swapped": "ac", "passage": "de", "other": "df"}
    row = df.select(*[fp.likeness(*p).alias(n) for n, p in pairs.items()], *[F.size(c).alias(f"n{c}") for c in "de"]).first()
    assert row.inserted > 0.9 and row.swapped > 0.95
    # A shared passage has about an anchor in 8 bytes, all of them in both fingerprints.
    assert row.passage * (row.nd + row.ne) > 20 and row.other * (row.nd + row.ne) < 5


def test_single_fingerprint_column(spark, texts):
    out = fp.fingerprint(texts([(1, None), (2, ""), (3, "short"), (4, "short")])).collect()
    found = {r.doc_id: r.fingerprint for r in out}
    assert found[1] == found[2] == "" and found[3] == found[4] != ""


def test_query(spark, documents, sf_dir):
    out = op4_fingerprints(spark, sf_dir).collect()
    edits = {i: e for i, _, e in plain_edits([(r.doc_id, r.text) for r in documents.collect()])}
    assert {r.doc_id: r.edited_sha256 for r in out} == {i: sha256(e.encode()).hexdigest() for i, e in edits.items()}
    assert sum(r.near_edited > r.near_next for r in out) > 0.95 * len(out)


def test_levels_are_not_cut_one_by_one(spark):
    # Periodic texts have equal inner strings, so that anchors tie; short ones end within a group.
    raws = [(b"ab" * 40)[:n] for n in (0, fp.K - 1, fp.K, fp.K + 1, fp.K + 2, fp.K + 17, 80)] + [b"abcdefghijk" * 9, b"x" * 60]
    h = hashes(spark, [s for raw in raws for s in substrings(raw)])
    df = spark.createDataFrame([(i, bytearray(raw)) for i, raw in enumerate(raws)], "i int, raw binary")
    found = df.select("i", fp.anchors("raw").alias("a"))
    for r in found.collect():
        assert [(x >> 31, x & fp.PLACE) for x in r.a] == plain_anchors(raws[r.i], h)
    # Two levels of pairwise minima, with one copy each, and one cut at the end.
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("zip_with(") == 2 and plan.count("slice(") <= 3


def test_only_anchors_across_the_cut_are_looked_for(texts, monkeypatch):
    """The rest of an edited text's anchors are its parts' own."""
    made, rows = fp.anchors, some_rows()
    want = {r.doc_id: r.edited_fingerprint for r in fp.compare_with_edits(texts(rows)).collect()}

    def of_few(raw, offset="0"):
        short = (F.length(raw) <= 2 * fp.K - 2) | F.lit(raw != "fresh")
        return F.when(short, made(raw, offset)).otherwise(F.raise_error(F.lit("hashed again")))

    monkeypatch.setattr(fp, "anchors", of_few)
    assert {r.doc_id: r.edited_fingerprint for r in fp.compare_with_edits(texts(rows)).collect()} == want
