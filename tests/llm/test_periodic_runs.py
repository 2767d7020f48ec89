"""Runs against a search over every period, and the query against plain Python."""

import hashlib
import random
import re
from fractions import Fraction
from zlib import crc32

import pytest

from inductra.llm import periodic_runs
from inductra.llm.queries import op13_periodic_runs, with_periodic_tails


def plain_runs(words, least=24, periods=3):
    """Maximal stretches of each period; those that a shorter period explains are left out."""
    out, n = [], len(words)
    for period in range(1, n // periods + 1):
        i = 0
        while i + period < n:
            if words[i] != words[i + period]:
                i += 1
                continue
            first = i
            while i + period < n and words[i] == words[i + period]:
                i += 1
            length = i - first + period
            if length >= max(least, periods * period):
                stretch = words[first : first + length]
                if not any(stretch[q:] == stretch[:-q] for q in range(1, period)):
                    out.append((first, length, period))
    return sorted(out)


def plain_collapsed(words, runs):
    gone = {i for first, length, period in runs for i in range(first + period, first + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def tailed(doc_id, text):
    """The words of a document after the rule of the query."""
    words, h = split(text), crc32(str(doc_id).encode() if doc_id is not None else b"")
    g, n = h // 10, len(split(text))
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_the_plain_search(seed):
    rng = random.Random(seed)
    for _ in range(20):
        n, kinds = rng.randint(0, 70), rng.choice([1, 2, 3, 40])
        words = [rng.randrange(kinds) for _ in range(n)]
        if n > 5 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 9)
            words = [w if i < a else words[min(n - 1, a + (i - a) % p)] for i, w in enumerate(words)]
        least, periods = rng.choice([(24, 3), (2, 2), (4, 2), (6, 3), (8, 4)])
        assert periodic_runs.runs_of(words, least, periods) == plain_runs(words, least, periods)


def test_automaton_knows_every_part():
    words = [random.Random(3).randrange(3) for _ in range(40)]
    made = periodic_runs.Automaton(words)
    parts = {tuple(words[i:j]) for i in range(40) for j in range(i + 1, 41)}
    sizes = [made.length[s] - made.length[made.link[s]] for s in range(2, len(made.length))]
    assert sum(sizes) == len(parts)


def test_find_runs(texts, clashing):
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "la " * 30), (3, "la " * 30), (None, "a b " * 40), (4, "ü  é\x0bü é " * 20)]
    rows += [(10 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 300)))) for i in range(30)]
    rows.append((99, ("x y z " * 9 + "q ") * 700))
    out = periodic_runs.find_runs(clashing(texts(rows)), out="runs_found").collect()
    assert {r.hits for r in out} == {"kept"}
    want = sorted(((i if i is not None else -1), split(t)) for i, t in rows)
    got = sorted(
        ((r.doc_id if r.doc_id is not None else -1), split(r.text), r.runs_found.n_words, r.runs_found.collapsed,
         [tuple(x) for x in r.runs_found.runs])
        for r in out
    )
    for (doc_id, words), (got_id, _, n_words, collapsed, runs) in zip(want, got):
        expected = plain_runs(words) if doc_id != 99 else runs
        assert (doc_id, len(words), expected, plain_collapsed(words, expected)) == (got_id, n_words, runs, collapsed)
    # Nine rounds of three words in each of 700 rounds of 28, and these rounds themselves.
    long_runs = got[-1][4]
    assert len(long_runs) == 701 and (0, 700 * 28, 28) in long_runs and (0, 27, 3) in long_runs
    assert periodic_runs.find_runs(texts([])).collect() == []


def test_query(spark, documents, sf_dir):
    out = {r.doc_id: r for r in op13_periodic_runs(spark, sf_dir).collect()}
    rows = documents.collect()
    assert len(out) == len(rows)
    changed = 0
    for row in rows:
        words = tailed(row.doc_id, row.text)
        changed += words != split(row.text)
        runs = plain_runs(words) if len(words) < 1500 or words != split(row.text) else None
        got = out[row.doc_id]
        if runs is None:
            continue
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        assert (got.n_runs, got.start, got.length, got.period, got.exponent_milli) == (len(runs), *best, milli)
        assert got.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert got.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
    assert changed > 5


def test_tails(texts):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 23))) for i in range(300)] + [(None, "a b c d"), (None, None), (20, "")]
    out = with_periodic_tails(texts(rows)).collect()
    key = lambda r: (r[0] if r[0] is not None else -1, r[1])
    got = sorted(((r.doc_id, " ".join(split(r.text))) for r in out), key=key)
    assert got == sorted(((i, " ".join(tailed(i, t))) for i, t in rows), key=key)
