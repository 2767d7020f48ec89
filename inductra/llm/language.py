"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is one matrix of log-probabilities, languages by hash buckets, fitted on a bounded
sample of labelled texts and broadcast; its size is bounded by ``MAX_CELLS``. Texts are
scored in numpy: the n-grams of a text become a sparse vector of bucket counts, which is
multiplied with the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inductra.llm.common import GOLDEN, mix, tidy

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Bound on languages x buckets; with many languages there are fewer buckets.
MAX_CELLS = 1 << 22
#: Texts of each language that the model is fitted on, about; all of them where there are fewer.
SAMPLE_PER_LANGUAGE = 5_000
SMOOTHING = 0.5
UNKNOWN = "und"
#: Characters hashed at once.
PIECE = 1 << 18


@dataclass
class LanguageModel:
    languages: list[str]
    log_probs: np.ndarray  # buckets x languages
    log_priors: np.ndarray


def buckets_of(points: np.ndarray, buckets: int) -> np.ndarray:
    """The hash bucket of every character n-gram, all orders."""
    found = []
    points = points.astype(np.uint64) + np.uint64(1)
    for order in ORDERS:
        if len(points) < order:
            break
        size = len(points) - order + 1
        h = np.full(size, order, np.uint64)
        for i in range(order):
            h = h * GOLDEN + points[i : i + size]
        found.append((mix(h) & np.uint64(buckets - 1)).astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def bucket_counts(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur in a text, and how often. A long text is hashed in pieces."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    if len(points) <= 256:
        return np.unique(buckets_of(points, buckets), return_counts=True)
    counts = np.zeros(buckets, np.int64)
    overlap = max(ORDERS) - 1
    for start in range(0, len(points), PIECE):
        piece = points[max(0, start - overlap) : start + PIECE]
        counts += np.bincount(buckets_of(piece, buckets), minlength=buckets)
        if start:  # the overlap was counted by itself in the piece before
            counts -= np.bincount(buckets_of(piece[:overlap], buckets), minlength=buckets)
    at = np.flatnonzero(counts)
    return at, counts[at]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Count the n-grams of each language over a bounded sample of labelled texts.

    Rows without text or language are left out. The sample keeps about
    ``SAMPLE_PER_LANGUAGE`` rows of each language by a hash of ``key``, and all rows of
    smaller ones; priors are the same for all. An empty table gives a model without languages.
    """
    spark = df.sparkSession
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").count().limit(MAX_CELLS // 1024 + 1).collect()
    languages = sorted(r["lang"] for r in sizes)
    if len(languages) > MAX_CELLS // 1024:
        raise ValueError("more languages than a matrix of bounded size can hold")
    if not languages:
        return LanguageModel([], np.zeros((1, 0), np.float32), np.zeros(0))
    buckets = BUCKETS
    while buckets * len(languages) > MAX_CELLS:
        buckets //= 2
    # From an Arrow table: a list would start Python workers of a second kind, which stay for a while.
    names, parts = [r["lang"] for r in sizes], [min(1.0, SAMPLE_PER_LANGUAGE / r["count"]) for r in sizes]
    shares = spark.createDataFrame(pa.table({"lang": pa.array(names, pa.string()), "share": pa.array(parts, pa.float64())}))
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, n = bucket_counts(value, buckets)
                if name not in sums:
                    sums[name] = np.zeros(buckets, np.int64)
                sums[name][at] += n
        names = list(sums)
        data = [sums[n].tobytes() for n in names]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], ["lang", "n"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column("n"):
                total += np.frombuffer(value.as_py(), np.int64)
        p = np.log((total + SMOOTHING) / (total.sum() + SMOOTHING * buckets)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([p.tobytes()])], ["lang", "p"])

    schema = "lang string, n binary"
    summed = sample.mapInArrow(count, schema).groupBy("lang").applyInArrow(add, "lang string, p binary")
    found = {r["lang"]: np.frombuffer(r["p"], np.float32) for r in summed.collect()}
    languages = [x for x in languages if x in found]
    matrix = np.stack([found[x] for x in languages], axis=1) if languages else np.zeros((1, 0), np.float32)
    return LanguageModel(languages, matrix, np.zeros(len(languages)))


def judge(model: LanguageModel, text: str | None) -> tuple[str, float]:
    """Language and its posterior probability; ``und`` for a text without letters."""
    if not text or not model.languages or not has_letter(text):
        return UNKNOWN, 0.0
    at, n = bucket_counts(text, len(model.log_probs))
    scores = n @ model.log_probs[at].astype(np.float64) + model.log_priors
    best = int(np.argmax(scores))
    return model.languages[best], float(1 / np.exp(scores - scores[best]).sum())


def predict(model: LanguageModel, text: Column, df: DataFrame) -> Column:
    """A struct (lang_pred, score) for each text.

    Only the text is used. Null, empty and letterless texts are ``und`` with score 0, as is
    every text if nothing was learned; of two equally likely languages the first by name wins.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def judged(texts: pa.Array) -> pa.Array:
        found = [judge(shared.value, t.as_py()) for t in texts]
        tidy()
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            ["lang_pred", "score"],
        )

    return judged(text)
