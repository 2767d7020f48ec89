"""Predictions on held-out documents, and texts that have no language."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from inductra.llm import language
from inductra.llm.queries import op10_language_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def judged(model, df):
    out = df.withColumn("found", language.predict(model, F.col("text"), df))
    return {r.doc_id: (r.found.lang_pred, r.found.score) for r in out.collect()}


def test_odd_texts(spark, clashing):
    rows = [(i, "der die das und nicht", "de") for i in range(5)] + [(9 + i, "the and of not", "en") for i in range(5)]
    rows += [(20, None, "fr"), (21, "rien", None), (22, "", "es")]
    model = language.fit(labelled(spark, rows))
    assert model.languages == ["de", "en", "es"]
    asked = clashing(labelled(spark, [(1, None, None), (2, "", None), (3, "12 ²…!?", None), (4, "das und die", None), (5, "the of " * 9000, "de")]))
    found = judged(model, asked)
    assert found[1] == found[2] == found[3] == ("und", 0.0)
    assert found[4][0] == "de" and found[5][0] == "en"


def test_nothing_learned(spark):
    model = language.fit(labelled(spark, []))
    assert judged(model, labelled(spark, [(1, "some text", "en")])) == {1: ("und", 0.0)}
    assert judged(model, labelled(spark, [])) == {}


def test_equally_likely_languages_take_the_first_name(spark):
    model = language.fit(labelled(spark, [(1, "same words", "xx"), (2, "same words", "aa")]))
    assert judged(model, labelled(spark, [(3, "same", None)]))[3] == ("aa", 0.5)


def test_long_texts_count_as_in_one_piece(monkeypatch):
    text = "abc déf ghi " * 300
    whole = [x.tolist() for x in language.bucket_counts(text, 1 << 12)]
    monkeypatch.setattr(language, "PIECE", 1000)
    assert [x.tolist() for x in language.bucket_counts(text, 1 << 12)] == whole


def test_many_languages_have_fewer_buckets(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_CELLS", 1 << 13)
    model = language.fit(labelled(spark, [(i, f"wort{i} " * 3, f"l{i}") for i in range(6)]))
    assert model.log_probs.size <= 1 << 13 and len(model.languages) == 6


def plain_grams(text):
    """Counts of the buckets of all 1- to 3-grams, one character at a time."""
    full, found = (1 << 64) - 1, Counter()
    points = [ord(c) + 1 for c in text.lower()]
    for order in (1, 2, 3):
        for i in range(len(points) - order + 1):
            h = order
            for p in points[i : i + order]:
                h = (h * 0x9E3779B97F4A7C15 + p) & full
            h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & full
            h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & full
            found[(h ^ (h >> 31)) % language.BUCKETS] += 1
    return found


def test_naive_bayes_by_plain_counts(spark):
    rng = random.Random(12)
    words = {"de": ["der", "größe", "nicht", "und", "die"], "en": ["the", "and", "size", "not", "die"], "zz": ["漢字", "x", "nd"]}
    say = lambda name, n: " ".join(rng.choice(words[name]) for _ in range(n))
    rows = [(i, say(name, rng.randint(1, 9)), name) for i, name in enumerate(["de", "en", "zz"] * 8)]
    model = language.fit(labelled(spark, rows))
    sums = {name: Counter() for name in words}
    for _, text, name in rows:
        sums[name].update(plain_grams(text))
    asked = [(i, say(rng.choice(list(words)), 3) + " " + say("en", i % 3), None) for i in range(20)]
    found = judged(model, labelled(spark, asked))
    for i, text, _ in asked:
        scores = {}
        for name, counts in sorted(sums.items()):
            total = sum(counts.values()) + language.SMOOTHING * language.BUCKETS
            scores[name] = sum(n * math.log((counts[b] + language.SMOOTHING) / total) for b, n in plain_grams(text).items())
        best = max(scores, key=scores.get)
        share = 1 / sum(math.exp(s - scores[best]) for s in scores.values())
        assert found[i][0] == best and abs(found[i][1] - share) < 1e-3
