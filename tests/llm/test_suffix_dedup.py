"""Removed passages against a table of all windows."""

import random
import tracemalloc
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from inductra.llm import suffix_dedup
from inductra.llm.common import ragged
from inductra.llm.queries import op7_suffix_dedup

LAST = 1 << 62


def plain(rows):
    first = {}
    for i, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - 49):
            first[raw[p : p + 50]] = min(first.get(raw[p : p + 50], LAST), LAST if i is None else i)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < (LAST if i is None else i):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((str(i), kept, len(raw), spans))
    return sorted(out)


def cut(df):
    return sorted((str(r.doc_id), bytes(r.kept), r.n_bytes, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect())


@pytest.mark.parametrize("long", [1 << 14, 200])
def test_first_owners_of_windows(monkeypatch, long):
    monkeypatch.setattr(suffix_dedup, "LONG", long)
    rng = random.Random(long)
    for _ in range(60):
        letters = rng.choice(["ab", "abc", "the cat sat on ", "a"])
        base = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(3)]
        texts = [rng.choice(base)[rng.randint(0, 60) :] + rng.choice(base)[: rng.randint(0, 200)] for _ in range(8)]
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        first, count, hashes, of = suffix_dedup.runs(raw, offsets)
        got = suffix_dedup._owners_of_runs(raw, first, count, hashes, of, 0)
        known = {}
        for i, t in enumerate(texts):
            for p in range(len(t) - 49):
                known.setdefault(t[p : p + 50], i)
        assert got.tolist() == [known[t[p : p + 50]] for t in texts for p in range(len(t) - 49)]


def test_only_strings_that_meet_another_owner_are_ordered():
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = say(60)
    strings = [say(80), say(30) + passage, passage + say(9), say(50), passage[5:] + say(20), "r" * 70, "r" * 90, say(55)]
    owners = np.array([1, 2, 3, 4, 3, 5, 5, 6])
    raw = np.frombuffer("".join(strings).encode(), np.uint8)
    lengths = np.array([len(s) for s in strings])
    named = suffix_dedup.meets_others(raw, lengths, owners)
    assert named.tolist() == [False, True, True, False, True, False, False, False]
    assert suffix_dedup.meets_others(raw[:80], lengths[:1], owners[:1]).tolist() == [True]


def test_digests_tell_rows_of_one_id_apart(texts):
    rows = [(None, "a" * 60), (None, "b" * 60), (1, ""), (1, None)]
    out = suffix_dedup.remove_repeats(texts(rows)).collect()
    want = sorted((str(i), sha256((t or "").encode()).digest()) for i, t in rows)
    assert sorted((str(r.doc_id), bytes(r.text_sha256)) for r in out) == want


def test_odd_tables(texts, clashing, small_chunks):
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abcdé 漢") for _ in range(n))
    passage, line = say(120), "-" * 400
    rows = [(i, say(rng.randint(0, 90)) + rng.choice([passage, passage[20:], line, ""]) + say(30)) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "x" * 49), (43, "x" * 50), (7, rows[7][1]), (7, "y" + rows[3][1])]
    rows += [(None, rows[5][1]), (None, say(200)), (50, "".join(t for _, t in rows[:30]))]
    assert cut(clashing(texts(rows, 5))) == plain(rows)


def test_empty_table(texts):
    assert cut(texts([])) == []


def test_only_one_document(texts):
    assert cut(texts([(1, "ab" * 300)])) == [("1", b"ab" * 300, 600, 0)]


def test_cut_characters_are_left_out(spark):
    df = spark.createDataFrame([(bytearray("aé".encode()[:2]),), (bytearray(b"\xa9b"),), (None,)], "kept binary")
    out = df.select(suffix_dedup.whole_characters(F.col("kept")).alias("t"))
    assert [r.t for r in out.collect()] == ["a", "b", None]


def test_query(spark, documents, sf_dir):
    want = plain([(r.doc_id, r.text) for r in documents.collect()])
    got = sorted(
        (str(r.doc_id), r.kept_sha256, r.n_bytes, r.n_removed, r.n_spans) for r in op7_suffix_dedup(spark, sf_dir).collect()
    )
    assert got == sorted((i, sha256(k).hexdigest(), n, n - len(k), s) for i, k, n, s in want)
    assert any(n for *_, n in want)


def test_positions_of_runs_need_one_array():
    rng = np.random.default_rng(3)
    starts, lengths = rng.integers(0, 1 << 40, 5000), rng.integers(0, 400, 5000)
    want = np.concatenate([np.arange(a, a + n) for a, n in zip(starts, lengths)])
    tracemalloc.start()
    got = ragged(starts, lengths)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == want.tolist() and ragged(starts[:0], lengths[:0]).tolist() == []
    assert ragged(starts[:3], np.array([0, 2, 0])).tolist() == [starts[1], starts[1] + 1]
    assert peak < 2.3 * want.nbytes


def test_strings_that_meet_others_are_found_piece_by_piece(monkeypatch):
    rng = random.Random(4)
    parts = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(12)]
    strings = [b"".join(rng.sample(parts, 2))[: rng.randint(50, 120)] for _ in range(60)]
    owners = np.array([rng.randrange(20) for _ in strings])
    windows = [{s[i : i + 50] for i in range(len(s) - 49)} for s in strings]
    want = [any(w & v and o != p for v, p in zip(windows, owners)) for w, o in zip(windows, owners)]
    raw, lengths = np.frombuffer(b"".join(strings), np.uint8), np.array(list(map(len, strings)))
    assert suffix_dedup.meets_others(raw, lengths, owners).tolist() == want
    monkeypatch.setattr(suffix_dedup, "KEYS", 7)
    assert suffix_dedup.meets_others(raw, lengths, owners).tolist() == want
