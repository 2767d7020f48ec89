"""Every stage of the pipeline against a plain version on a small fixture, and the whole run."""

import random
import re
from itertools import count

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from inductra.llm.common import store

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with a letterless text, near copies, a shared passage, and benchmark passages."""
    rng = random.Random(9)
    words = {"en": [f"the{i}th" for i in range(300)], "de": [f"der{i}ß" for i in range(300)]}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    items = [(1, say("en", 14)), (2, "tiny item")]
    passage = say("en", 60)
    rows = [(i, say("en" if i % 2 else "de", 50), "en" if i % 2 else "de") for i in range(40)]
    rows += [(50, rows[3][1], "en"), (51, rows[4][1] + " extra", "de"), (3, rows[3][1], "en")]
    rows += [(52, say("en", 30) + " " + passage, "en"), (53, say("en", 30) + " " + passage + " " + say("en", 5), "en")]
    rows += [(54, say("en", 40) + " " + items[0][1], "en"), (55, say("en", 40) + " Tiny, ITEM! " + say("en", 3), "en")]
    rows += [(60, "123 ...", "en"), (61, None, "de"), (62, "", None), (63, passage, "en"), (None, say("de", 20), "de")]
    folder = str(tmp_path_factory.mktemp("sf"))
    table = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items, passage


@pytest.fixture(scope="module")
def steps(spark, corpus):
    """What each stage makes of the one before, stored as the pipeline does."""
    docs, out = spark.read.parquet(f"{corpus[0]}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, corpus[0]), "test-stage")
        out.append(docs)
    return out


def ids(df):
    return sorted(str(r.doc_id) for r in df.collect())


def test_stages_keep_the_columns(steps):
    assert [df.columns for df in steps[:4]] == [COLUMNS] * 4


def test_language_rejects_what_has_no_letter(steps, corpus):
    assert ids(steps[0]) == sorted(str(i) for i, t, _ in corpus[1] if t and re.search(r"[^\W\d_]", t))


def test_one_of_each_group_stays(steps, corpus):
    assert ids(steps[1]) == sorted({str(i) for i, _, _ in corpus[1]} - {"50", "51", "60", "61", "62"})


def test_repeated_passages_go(steps, corpus):
    _, rows, _, passage = corpus
    left = {r.doc_id: r for r in steps[2].collect()}
    assert set(map(str, left)) == {str(i) for i, _, _ in rows} - {"50", "51", "60", "61", "62", "63"}
    assert passage in left[52].text and passage[10:-10] not in left[53].text
    assert all(r.n_chars == len(r.text) for r in left.values())


def test_benchmark_passages_go(steps):
    left = {r.doc_id: r for r in steps[3].collect()}
    assert 54 not in left and "ITEM" not in left[55].text and "Tiny" not in left[55].text


def test_clean_documents_stay_as_they_are(steps, corpus):
    left = {r.doc_id: r.text for r in steps[3].collect()}
    assert all(left[i] == t for i, t, _ in corpus[1] if i is not None and i < 40 and i != 3)
    assert left[3] == corpus[1][3][1]


def test_last_stage_encodes(steps):
    before = {str(r.doc_id): r.text for r in steps[3].collect()}
    out = steps[4].collect()
    assert {str(r.doc_id) for r in out} == set(before)
    for r in out:
        assert r.ids == LIBRARY.encode(before[str(r.doc_id)])
        assert r.n_tokens == len(r.ids) and r.lossless


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_extra_columns_pass(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'x' AS ids", "1 AS chunk", "2 AS kept")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = store(stage(spark, docs, folder), "test-stage")
        assert docs.columns == [*COLUMNS, "ids", "chunk", "kept"]


def test_rows_without_id_and_ids_that_are_there_twice(spark):
    say = lambda seed: " ".join(random.Random(seed).choices([f"w{i}" for i in range(200)], k=30))
    rows = [(None, say(1)), (5, say(1)), (5, say(1)), (None, say(2)), (None, say(2) + " more"), (6, say(3)), (6, say(4)), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(2)
    docs = store(docs, "test-rows")
    kept = sorted((str(r.doc_id), r.text[:8]) for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    want = [(5, say(1)), (None, say(2)), (6, say(3)), (6, say(4)), (7, "")]
    assert kept == sorted((str(i), t[:8]) for i, t in want)


def test_texts_are_scanned_once_for_the_benchmark(spark, corpus, capsys):
    """A filter on the hits does not scan again, in further workers."""
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    corpus_pipeline.without_benchmark(spark, docs, corpus[0]).explain()
    plan = capsys.readouterr().out.split("Initial Plan")[0]
    assert plan.count("ArrowEvalPython [scanned") == 1


def test_language_starts_one_kind_of_worker(spark, corpus, monkeypatch):
    """A list of rows, or another environment later on, would start Python workers beside the idle ones."""
    context = spark.sparkContext
    monkeypatch.delitem(context.environment, "PYTHONPATH", raising=False)
    monkeypatch.setattr(context, "parallelize", lambda *_, **__: pytest.fail("a list of rows"))
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    assert corpus_pipeline.known_language(spark, docs, corpus[0]).count()
    held = context.environment["PYTHONPATH"]
    corpus_pipeline.table(spark, corpus[0], "benchmark")
    assert context.environment["PYTHONPATH"] == held


def test_passages_are_cut_and_read_in_one_step(spark, corpus, capsys):
    """Texts that were cut do not pass through a further Python step; characters cut in two go whole."""
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    corpus_pipeline.without_repeats(spark, docs, corpus[0]).explain()
    assert "ArrowEvalPython" not in capsys.readouterr().out
    shared = "".join(chr(0x4E00 + i) for i in range(40))
    rows = [(1, "ab" + shared), (2, "cd丁" + shared + "é"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = corpus_pipeline.suffix_dedup.remove_repeats(df).withColumn("t", corpus_pipeline.suffix_dedup.whole_characters("kept"))
    whole = corpus_pipeline.suffix_dedup.remove_repeats(df, whole=True)
    assert {r.doc_id: r.t for r in cut.collect()} == {r.doc_id: r.kept for r in whole.collect()} == {1: rows[0][1], 2: "cd丁é", 3: ""}


def test_other_columns_go_along_with_cut_texts(spark, corpus, capsys):
    """Cut texts are neither grouped nor joined to their rows; only chunks meet their answers."""
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    corpus_pipeline.without_repeats(spark, docs, corpus[0]).explain()
    plan = capsys.readouterr().out.split("Initial Plan")[-1]
    assert plan.count("Join") == 1 and "MapInArrow" not in plan[plan.index("Join") :]
    rows = [(2, "b" * 60 + "x", 4, ["q", None]), (1, "b" * 60, 3, []), (2, "b" * 60 + "x", 5, None), (None, "c", 6, ["r"])]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_chars bigint, `odd name` array<string>").repartition(2)
    df = df.withColumns({"kept": F.struct(F.col("odd name").alias("a")), "at": F.lit("2024-02-03 04:05:06").cast("timestamp")})
    out = corpus_pipeline.without_repeats(spark, df, "")
    assert out.columns == df.columns and [t for _, t in out.dtypes] == [t for _, t in df.dtypes]
    want = [(2, "x", 1, ["q", None]), (1, "b" * 60, 60, []), (2, "x", 1, None), (None, "c", 1, ["r"])]
    assert sorted(map(repr, out.select(*df.columns[:4]).collect())) == sorted(
        repr(r) for r in spark.createDataFrame(want, df.select(*df.columns[:4]).schema).collect()
    )
    assert all(r.kept.a == r["odd name"] and r.at.isoformat() == "2024-02-03T04:05:06" for r in out.collect())


def test_stored_steps_are_removed(spark, corpus, monkeypatch, tmp_path):
    """Of near-duplicates only what the result reads is left, of passages only chunks and answers."""
    number = count()
    monkeypatch.setattr("inductra.llm.common.run_folder", lambda _, label: f"{tmp_path}/{label}-{next(number)}")
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    label = lambda folder: folder.name.rsplit("-", 1)[0]
    assert corpus_pipeline.one_of_each(spark, docs, "").count()
    assert {"row-classes", "roots"} <= set(map(label, tmp_path.iterdir()))
    assert set(map(label, tmp_path.iterdir())) <= {"row-classes", "roots", "frequent-shingles", "component-links"}
    before = set(tmp_path.iterdir())
    assert corpus_pipeline.without_repeats(spark, docs, "").count()
    assert set(map(label, set(tmp_path.iterdir()) - before)) == {"chunks", "first-owners"}
