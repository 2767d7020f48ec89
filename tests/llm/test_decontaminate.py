"""Hits against a plain search, and both ways of finding them against each other."""

import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from inductra.llm.decontaminate import find_hits, without_spans
from inductra.llm.queries import op3_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(documents, items):
    out = []
    for doc_id, text in documents:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for item_id, item in items:
            wanted = WORD.findall(lower(item))
            n = min(10, len(wanted))
            windows = {tuple(wanted[i : i + n]) for i in range(len(wanted) - n + 1)} if n else set()
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(str(item_id))
        out.append((doc_id, len(words), len(hit), sorted(found)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.hits.n_words, r.hits.n_hit, r.hits["items"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(7)
    vocabulary = ["Alpha", "beta", "gamma", "délta", "x1", "漢", "the", "of", "and", "to", "in", "is", "Zed"]
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".", " -"]) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(2, 14)]
    items += [(14, None), (15, "... "), (16, items[3][1]), (3, items[1][1]), (None, "the Zed 漢 x1")]
    documents = []
    for i in range(60):
        text = say(rng.randint(0, 40))
        if i % 3 == 0:
            text += " " + rng.choice(items)[1].upper() if rng.choice(items)[1] else ""
        documents.append((i, text))
    documents += [(60, None), (61, ""), (5, documents[5][1]), (None, items[5][1]), (62, "word " * 3000 + items[5][1])]
    return documents, items


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_hits_equal_a_plain_search(spark, texts, clashing, tables, bound):
    documents, items = tables
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    known = [(i, t) for i, t in items if i is not None]
    # An item without an id cannot be named; both ways leave out its name, not its words.
    out = find_hits(clashing(texts(documents)).drop("hits"), bench.where("item_id IS NOT NULL"), bound=bound)
    assert rows_of(out) == plain(documents, known)
    assert {r.n_tokens for r in out.collect()} == {"kept"}


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_items_without_an_id_are_hit_and_not_named(spark, texts, tables, bound):
    documents, items = tables
    documents = documents + [(70, "so the Zed, 漢 x1 it is"), (71, "only here are these words said")]
    items = items + [(None, "only here are these words")]
    out = find_hits(texts(documents), spark.createDataFrame(items, "item_id bigint, text string"), bound=bound)
    want = plain(documents, items)
    assert rows_of(out) == [(i, n, hit, [x for x in found if x != "None"]) for i, n, hit, found in want]
    unnamed = sorted(((r.doc_id, r.hits.unnamed) for r in out.collect()), key=str)
    assert unnamed == sorted(((i, "None" in found) for i, _, _, found in want), key=str)
    assert (71, True) in unnamed


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_empty_tables(spark, texts, bound):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert rows_of(find_hits(texts([(1, "a b")]), bench, bound=bound)) == [(1, 2, 0, [])]
    full = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert rows_of(find_hits(texts([]), full, bound=bound)) == []


def test_spans_cut_out_what_was_hit(spark, texts):
    bench = spark.createDataFrame([(1, "Eins zwei dréi")], "item_id bigint, text string")
    found = find_hits(texts([(1, "Vor eins, ZWEI dréi. Nach é"), (2, "nichts"), (3, None)]), bench)
    cut = found.select("doc_id", without_spans(F.col("text"), F.col("hits.spans")).alias("t"))
    assert sorted(map(tuple, cut.collect())) == [(1, "Vor . Nach é"), (2, "nichts"), (3, None)]


def test_query(spark, documents, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    want = plain([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in bench])
    got = {r.doc_id: r for r in op3_decontamination(spark, sf_dir).collect()}
    assert len(got) == len(want)
    assert any(w[2] for w in want)
    for doc_id, n_words, n_hit, items in want:
        r = got[doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (n_words, n_hit, len(items))
        assert r.items_sha256 == sha256(",".join(items).encode()).hexdigest()
        assert r.contaminated == (n_hit > 0)
