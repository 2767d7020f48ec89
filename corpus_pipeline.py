"""A training corpus from raw documents, in stages that each apply one operator.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written and read again as the next one's ``docs``. All but the last
return the columns of ``docs``. Rows without ``doc_id`` are compared like all others and come
last among them. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inductra.llm import decontaminate, jaccard_join, language, pieces, suffix_dedup
from inductra.llm.common import on_workers, store, table
from inductra.llm.queries import PIECE_BPE

#: Posterior probability of a language below which a document is rejected.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language learned from the labelled ones.

    Texts that are missing or have no letter go, and those whose language is open.
    """
    on_workers(spark)
    model = language.fit(docs)
    judged = docs.withColumn("__found", language.predict(model, F.col("text"), docs))
    fine = (F.col("__found.lang_pred") != language.UNKNOWN) & (F.col("__found.score") >= LEAST_SCORE)
    return judged.where(fine).drop("__found")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near-duplicates: the one with the smallest id.

    Documents without an id come after all others. Rows are compared by their number in the
    stored table, so neither a missing id nor one that is there twice matters; of equal ids in
    a component the first row stays.
    """
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    found = jaccard_join.near_duplicates(rows.select("__row", "text"), row_id="__row")
    ids = rows.select("__row", F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"))
    placed = found.select("__row", "component_id").join(ids, "__row")
    chosen = placed.groupBy("component_id").agg(F.min(F.struct("missing", "id", "__row")).alias("least"))
    return rows.join(chosen.select("least.__row"), "__row", "left_semi").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document holds; documents with nothing else go.

    A character of which only a part was cut is cut whole. ``n_chars`` follows the text. The other
    columns go along with it, so texts are not joined to them.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = suffix_dedup.remove_repeats(docs, whole=True, rest=others).where(F.trim("kept") != "")
    shorter = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("bigint")}
    return found.select(*[shorter.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a full benchmark window; cut shorter hits out of the others."""
    found = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"), out="__hits")
    clean = found.where(F.col("__hits.longest") < decontaminate.WINDOW)
    text = F.when(F.col("__hits.n_hit") > 0, decontaminate.without_spans(F.col("text"), F.col("__hits.spans")))
    cut = clean.withColumn("text", F.coalesce(text, "text"))
    return cut.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether these decode to the text itself."""
    coded = pieces.encode(docs, PIECE_BPE, out="__coded")
    return coded.select(
        *docs.columns,
        F.col("__coded.ids").alias("ids"),
        F.size("__coded.ids").cast("bigint").alias("n_tokens"),
        (F.col("__coded.decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("repeated_passages", without_repeats),
    ("benchmark", without_benchmark),
    ("encoding", encoded),
]

#: Models and encoders are not SQL; tests check planted cases stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
