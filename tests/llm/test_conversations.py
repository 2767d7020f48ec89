"""Repairs against a search over all edits, in one block and in many."""

import hashlib
import heapq
import random
import re
from zlib import crc32

import pytest

from inductra.llm import common, conversations
from inductra.llm.queries import damaged_conversations, op12_conversations

LEGAL = re.compile(r"(s?(ua)+)?")


def dead_end(initials):
    """No continuation makes these initials legal."""
    return not any(LEGAL.fullmatch(initials + more) for more in ("", "a", "ua", "uaua"))


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        if not stripped:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif stripped[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append(None)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, audit, repaired) by a search in the order of cost, then audit, over whole edit sequences."""
    faults = plain_faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        # What follows depends on the last initial only, and on whether there is any.
        place = (i, initials[-1:])
        if place in done:
            continue
        if i == len(rows) and LEGAL.fullmatch(initials):
            return cost, audit, [x for x in out]
        # A dearer or later sequence at the same place cannot win, but an equal one is popped in order.
        done.add(place)
        options = [("I", 3, i, role, "") for role in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            options.append(("D", 4, i + 1, None, None))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] else 0
                options.append(("K", more, i + 1, role, text))
                options += [("R", 3 + more, i + 1, to, text) for to in ("user", "assistant")]
        for letter, price, j, role, text in options:
            now = initials if role is None else initials + role[:1]
            if role is not None and (not role or dead_end(now)):
                continue
            lines = out if role is None else (*out, f"{role}:{text}")
            heapq.heappush(heap, (cost + price, audit + letter, j, now, lines))


def plain_summary(rows):
    """Rows (turn, role, text) in any order."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults = plain_faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, lines = plain_repair(rows)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def some_rows(rng, n, kinds=("system", "user", "assistant")):
    words = ["Yes.", "No", "why?", "", " \t", "done!", "so on", "é.\n", "a.\x0b"]
    return [(rng.choice([*range(n), None]), rng.choice([*kinds, "tool", "", None]), rng.choice([*words, None])) for _ in range(n)]


def summaries(df):
    return {r.conv: tuple(r)[1:] for r in df.collect()}


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("block", [2, 5, None])
def test_repairs_equal_the_search(spark, monkeypatch, block):
    rng = random.Random(block or 0)
    by_conv = {c: some_rows(rng, rng.randint(1, 12)) for c in [*range(80), None]}
    by_conv[500] = [(t, "user" if t % 2 else "assistant", f"t{t // 3}.") for t in range(60)]
    by_conv[501] = [(1, "user", "Hi.")] * 30 + [(2, "assistant", "Ho.")] * 3
    rows = [(c, *r) for c, rs in by_conv.items() for r in rs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.selectExpr("*", "'kept' AS conv", "1 AS part", "2 AS block", "'x' AS audit", "0 AS copies")
    monkeypatch.setattr(common, "BROADCAST_GROUPS", 0 if block == 2 else 1000)
    out = conversations.repair(df, block_rows=block)
    assert block is None or out.agg({"parts": "max"}).first()[0] > 1
    got = summaries(conversations.summarise(out))
    assert got == {c: plain_summary(rs) for c, rs in by_conv.items()}


def test_long_texts_cut_blocks(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} " + "x" * 5000 + ".") for t in range(20)]
    out = conversations.repair(spark.createDataFrame(rows, SCHEMA), block_bytes=12_000)
    assert out.count() > 5
    assert summaries(conversations.summarise(out)) == {1: plain_summary([r[1:] for r in rows])}


def test_nothing(spark):
    assert conversations.summarise(conversations.repair(spark.createDataFrame([], SCHEMA))).collect() == []


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if v is None else str(v) for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        fault = crc32(f"{conv_text}:{turn_text}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def test_damage(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 30, None]), *r) for r in some_rows(rng, 200)]
    got = damaged_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, plain_damage(rows)))


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = {r[0]: [] for r in rows}
    for conv, *rest in plain_damage(rows):
        left[conv].append(tuple(rest))
    out = op12_conversations(spark, sf_dir)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in out.collect()} == {c: plain_summary(rs) for c, rs in left.items()}
