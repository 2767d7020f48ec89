"""One registered query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inductra.llm import (
    conversations,
    decontaminate,
    fingerprints,
    jaccard_join,
    language,
    lm_score,
    periodic_runs,
    pieces,
    sharding,
    suffix_dedup,
    token_counts,
    url_filters,
    warc,
)
from inductra.llm.common import crc_of_id, table
from inductra.llm.oracles import ORACLES
from inductra.session import run_folder

__all__ = ["ORACLES", "QUERIES"]

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 512
SHARDS = 24

URL_RULES = [
    url_filters.Rule("com", "/", "allow"),
    url_filters.Rule("example.com", "/en/", "block"),
    url_filters.Rule("www.example.com", "/en/", "allow"),
    url_filters.Rule("net", "/es/", "block"),
    url_filters.Rule("net", "/fr/", "block"),
]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of near-equal bytes, equal texts together."""
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, and whether they are over the limit of one sequence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        token_counts.token_count(F.col("text"), BYTE_BPE).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document, and the items they come from.

    All items without an id count as one and are not named, as in SQL.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        F.col("hits.n_hit").alias("n_hit"),
        (F.size("hits.items") + F.col("hits.unnamed").cast("int")).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.items").cast("binary"), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of an edited form, and how alike they are."""
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every text under a model of four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) == 1
    model = lm_score.fit(docs.where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), lm_score.score(F.col("text"), model).alias("s"))
    return scored.select(
        "doc_id",
        "held_out",
        "s.n_tokens",
        "s.n_known",
        F.lit(model.train_tokens).cast("bigint").alias("train_tokens"),
        "s.base_score",
        "s.score",
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the url of every page."""
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without passages of earlier documents."""
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near-duplicates of every document."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text and of what they decode to."""
    coded = pieces.encode(table(spark, sf_dir, "documents"), PIECE_BPE, out="e", keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("e.ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("e.ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("e.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2
    model = language.fit(docs.where(~held_out))
    judged = docs.select(
        "doc_id", held_out.alias("held_out"), language.predict(model, F.col("text"), docs).alias("found")
    )
    return judged.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written into archives, payloads that repeat as references, and read back."""
    pages = warc.with_references(table(spark, sf_dir, "pages"), "page_id", "html")
    files = warc.write(warc.chunk_rows(pages, "page_id", "url", "html"), run_folder(spark, "warc"))
    return warc.read(files, data=False).select(
        F.col("record_id").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults, by the checksum of conversation and turn.

    Of 20 rows about one each is dropped, emptied, left without stops, repeated, or said by the user.
    """
    blank = F.lit(" ")
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    text, role = F.coalesce(F.col("text"), blank), F.coalesce(F.col("role"), blank)
    fault = F.col("fault")
    marked = rows.withColumn("fault", F.crc32(place.cast("binary")) % 20).where("fault <> 0")
    damaged = marked.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
    )
    return damaged.drop("copy")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, and the cheapest repair."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversations.summarise(conversations.repair(damaged_conversations(rows)))
    ids = rows.select("conv_id").distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    none = F.lit(0).cast("bigint")
    counts = [F.coalesce(c, none).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select(
        "conv_id",
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which one document in ten repeats a part of itself up to its end.

    With h the checksum of the id (a missing one counts as the empty text) and g its tenth, the
    words from number g mod n on repeat with period 1 + (n - a) div (3 + g mod 8).
    """
    h = crc_of_id(F.col("doc_id"))
    g = F.floor(h / 10).cast("bigint")
    parts = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, parts).alias("w"))
    n = F.size("w").cast("bigint")
    sized = cut.withColumn("a", F.when(n > 0, F.col("g") % n))
    sized = sized.withColumn("p", F.when(n > 0, F.expr("1 + (size(w) - a) div (3 + g % 8)")))
    a, p = F.col("a"), F.col("p")

    def word(i):
        return F.get("w", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))

    altered = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), word), " ")
    return sized.select("doc_id", F.when(n > 0, altered).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in every text, the strongest of them, and the text without repetitions."""
    docs = with_periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.find_runs(docs, keep=["doc_id"])
    # Runs come by start, then period, so among equal exponents the first one stays.
    more = "(acc, r) -> CASE WHEN acc IS NULL OR r.length * acc.period > acc.length * r.period THEN r ELSE acc END"
    kind = "struct<start: bigint, length: bigint, period: bigint>"
    best = F.expr(f"aggregate(found.runs, CAST(NULL AS {kind}), {more})")
    line = F.transform("found.runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    judged = found.withColumn("best", best)
    return judged.select(
        "doc_id",
        F.size("found.runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("found.collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_fingerprints": op4_fingerprints,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_url_filters": op6_url_filters,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_language_id": op10_language_id,
    "op11_warc": op11_warc,
    "op12_conversations": op12_conversations,
    "op13_periodic_runs": op13_periodic_runs,
}
