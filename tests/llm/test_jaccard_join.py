"""Components against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from inductra.llm import jaccard_join
from inductra.llm.components import components, joined_roots
from inductra.llm.jaccard_join import near_duplicates
from inductra.llm.queries import op8_jaccard_join


def plain(rows):
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    having = {}
    for k, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in having.get(g, ())).items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                up[root(k)] = root(j)
        for g in s:
            having.setdefault(g, []).append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((str(i), len(s), str(least.get(root(k)))) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_duplicates(df).collect())


@pytest.mark.parametrize("frequent", [32, 3])
def test_odd_tables(texts, clashing, small_chunks, monkeypatch, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for _ in range(10):
        base = say(rng.randint(1, 80))
        for _ in range(rng.randint(1, 20)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    passage = " ".join(say(40))
    rows += [(len(rows) + k, passage + " " + " ".join(say(rng.randint(5, 20)))) for k in range(30)]
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "a b"), (n + 4, "A  b\t"), (n + 5, "é É"), (n + 6, "É É")]
    rows += [(3, rows[3][1]), (None, rows[8][1]), (None, "only here " * 20), (n + 7, " ".join(say(3000)))]
    rng.shuffle(rows)
    assert found(clashing(texts(rows, 5))) == plain(rows)


def test_large_group_of_near_copies(texts, small_chunks):
    rng = random.Random(5)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(150):
        copy = list(base)
        copy[rng.randrange(60)] = f"own{i}"
        rows.append((i, " ".join(copy)))
    got = found(texts(rows))
    assert {r[2] for r in got} == {"0"}
    assert got == plain(rows)


def test_empty_table(texts):
    assert found(texts([])) == []


def test_frequent_shingles_are_bounded(spark, monkeypatch):
    rows = [(i, i, list(range(100)) + [1000 + i // 2]) for i in range(80)] + [(i, i, [1000 + i // 2]) for i in range(80, 120)]
    sets = spark.createDataFrame(rows, "node bigint, n bigint, shared array<bigint>")
    tokens, levels = jaccard_join.frequent_shingles(sets)
    assert tokens.tolist() == list(range(100)) and set(levels.tolist()) == {6}
    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    assert len(jaccard_join.frequent_shingles(sets)[0]) == 160
    monkeypatch.setattr(jaccard_join, "MOST_FREQUENT", 120)
    assert jaccard_join.frequent_shingles(sets)[0].tolist() == list(range(100))


def test_sketches_bound_the_overlap(spark):
    rng = random.Random(9)
    sets = [rng.sample(range(-500, 500), rng.randint(0, 300)) for _ in range(20)]
    sets += [s[:-3] + [2000 + i] for i, s in enumerate(sets)]
    bits = [jaccard_join.sketch(np.array(s, np.int64)).tolist() for s in sets]
    pairs = [(len(a), len(b), x, y, len(set(a) & set(b))) for a, x in zip(sets, bits) for b, y in zip(sets, bits)]
    df = spark.createDataFrame(pairs, "m_a int, m_b int, sketch_a array<bigint>, sketch_b array<bigint>, both int")
    rows = df.select("m_a", "m_b", "both", jaccard_join.most_by_sketch().alias("most")).collect()
    assert all(r.both <= r.most <= (r.m_a + r.m_b) / 2 for r in rows)
    assert sum(r.most < min(r.m_a, r.m_b) for r in rows) > len(rows) / 4


def test_a_pair_meets_about_once(spark):
    rng = random.Random(11)
    base = rng.sample(range(1 << 40), 100)
    sets = [sorted(rng.sample(base, 95) + rng.sample(range(1 << 40), 5)) for _ in range(30)]
    sets += [sorted(rng.sample(range(1 << 40), 100)) for _ in range(10)]
    rows = [(t, i, 100, at, i) for i, s in enumerate(sets) for at, t in enumerate(s[:26])]
    mixed = spark.createDataFrame(rows, "token bigint, node bigint, n bigint, at bigint, root bigint")
    rows = [(i, 100, 100, jaccard_join.sketch(np.array(s, np.int64)).tolist()) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node bigint, n bigint, m bigint, sketch array<bigint>")
    met = [(r.a, r.b) for r in jaccard_join._meetings(mixed, nodes).collect()]
    pairs = {(i, j) for j in range(40) for i in range(j)}
    links = {(i, j) for i, j in pairs if 100 * len(set(sets[i]) & set(sets[j])) >= 75 * len(set(sets[i]) | set(sets[j]))}
    assert len(links) > 100 and links <= set(met)
    # Linked pairs share some 20 of their first shingles, each of which was a row before.
    assert len(met) < 1.2 * len(set(met))


def test_components(spark):
    rng = random.Random(6)
    links = [(f"{a:03}", f"{a + 1:03}") for a in range(100)] + [("900", f"9{k:02}") for k in range(1, 40)]
    links += [("500", "500"), ("700", "600"), ("700", "600")]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    want = {f"{a:03}": "000" for a in range(101)} | {f"9{k:02}": "900" for k in range(40)} | {"600": "600", "700": "600"}
    assert got == want
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []
    more = [("050", "600"), ("920", "999"), ("010", "011"), ("111", "222")]
    both = components(spark.createDataFrame(links + more, "a string, b string"))
    after = joined_roots(components(spark.createDataFrame(links, "a string, b string")), spark.createDataFrame(more, "a string, b string"))
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, both.collect()))


def test_query(spark, documents, sf_dir):
    want = plain([(r.doc_id, r.text) for r in documents.collect()])
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in op8_jaccard_join(spark, sf_dir).collect())
    assert got == want
