"""Benchmark decontamination by word windows.

Windows are ``WINDOW`` consecutive words of a benchmark item, or all words of a shorter
one. Up to ``BROADCAST_WORDS`` benchmark words the windows are broadcast as sorted hash
arrays with the words to verify against; each text is scanned once, without a shuffle. A
larger benchmark is joined by window hash, and the scan then verifies against the few items
that the join found for a text. Both give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inductra.llm.common import GOLDEN, list_array, mix, tidy

WINDOW = 10
#: Benchmark words up to which the windows are broadcast (about 100 bytes each).
BROADCAST_WORDS = 2_000_000

#: Word bytes: digits, letters and all bytes of other characters; A-Z become a-z.
_KEEP = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def split_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased. A missing text has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of ``size`` numbers."""
    count = len(ids) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(count, size, np.uint64)
    for i in range(size):
        h = h * GOLDEN + ids[i : i + count]
    return mix(h)


@dataclass
class Windows:
    """Benchmark windows: for each size sorted hashes, and per hash the windows to verify."""

    numbers: dict[bytes, int] = field(default_factory=dict)
    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    behind: dict[int, dict[int, dict[tuple[int, ...], set]]] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple[object, list[bytes]]], size: int = WINDOW) -> Windows:
        self = cls()
        for item_id, item in items:
            if not item:
                continue
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in item], np.uint64)
            length = min(size, len(ids))
            known = self.behind.setdefault(length, {})
            for at, h in enumerate(window_hashes(ids, length).tolist()):
                key = tuple(ids[at : at + length].tolist())
                known.setdefault(h, {}).setdefault(key, set()).add(item_id)
        self.hashes = {n: np.array(sorted(known), np.uint64) for n, known in self.behind.items()}
        return self

    def scan(self, document: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words of a document are hit, and the items whose windows occur."""
        ids = np.fromiter((self.numbers.get(w, 0) for w in document), np.uint64, len(document))
        hit = np.zeros(len(ids), bool)
        items: set = set()
        known = np.flatnonzero(ids)
        if len(known) == 0:
            return hit, items
        runs = np.split(known, np.flatnonzero(np.diff(known) > 1) + 1)
        for length, hashes in self.hashes.items():
            for run in runs:
                if len(run) < length:
                    continue
                found = window_hashes(ids[run[0] : run[-1] + 1], length)
                at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                for start in (np.flatnonzero(hashes[at] == found) + run[0]).tolist():
                    key = tuple(ids[start : start + length].tolist())
                    owners = self.behind[length][int(found[start - run[0]])].get(key)
                    if owners:
                        hit[start : start + length] = True
                        items |= owners
        return hit, items


HITS = (
    "struct<n_words: bigint, n_hit: bigint, longest: bigint, items: array<string>, unnamed: boolean,"
    " spans: array<struct<start: bigint, end: bigint>>>"
)


def hit_runs(hit: np.ndarray) -> list[np.ndarray]:
    """Numbers of the hit words, run by run."""
    at = np.flatnonzero(hit)
    return [r for r in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(r)]


def spans_of(text: str, runs: list[np.ndarray]) -> list[dict]:
    """Character spans of runs of words, for cutting them out."""
    inside = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_KEEP), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    raw = text.encode("utf-8", "surrogatepass")
    before = lambda at: len(raw[:at].decode("utf-8", "surrogatepass"))
    return [{"start": before(start[r[0]]), "end": before(end[r[-1]])} for r in runs]


def judge(windows: Windows, text: str | None) -> dict:
    document = split_words(text)
    hit, items = windows.scan(document)
    runs = hit_runs(hit)
    return {
        "n_words": len(document),
        "n_hit": int(hit.sum()),
        "longest": max(map(len, runs), default=0),
        "items": sorted(map(str, items - {None})),
        "unnamed": None in items,
        "spans": spans_of(text, runs) if runs else [],
    }


def judged_type() -> pa.DataType:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.struct(
        [
            ("n_words", pa.int64()),
            ("n_hit", pa.int64()),
            ("longest", pa.int64()),
            ("items", pa.list_(pa.string())),
            ("unnamed", pa.bool_()),
            ("spans", pa.list_(span)),
        ]
    )


def find_hits(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
              item_text: str = "text", out: str = "hits", bound: int = BROADCAST_WORDS) -> DataFrame:
    """``df`` with a column ``out``: words, hit words, items found and spans to remove.

    ``n_words`` and ``n_hit`` count words, ``longest`` those of the longest hit run; ``items`` are the ids of items found, sorted as
    strings, without those that have none, and ``unnamed`` says whether one without was found;
    ``spans`` are character ranges. Null texts have no words; items without words are
    never found; repeated items count once by id. Other columns stay as they are.
    """
    bench = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("words"))
    bench = bench.where("words IS NOT NULL")
    total = bench.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    if total <= bound * 8:
        rows = [(r["id"], split_words(r["words"])) for r in bench.collect()]
        shared = df.sparkSession.sparkContext.broadcast(Windows.of(rows))

        @F.arrow_udf(HITS)
        def scanned(texts: pa.Array) -> pa.Array:
            found = pa.array([judge(shared.value, t.as_py()) for t in texts], judged_type())
            tidy()
            return found

        # Else a filter on what is found would have every text scanned a second time, below the filter.
        return df.withColumn(out, scanned.asNondeterministic()(F.col(text)))
    return _joined(df, bench, text, out)


def _windows_column(text: Column, whole_if_shorter: bool, sizes: list[int]) -> Column:
    """Hashes of the distinct word windows of a text, for the join."""

    @F.arrow_udf("array<bigint>")
    def hashed(texts: pa.Array) -> pa.Array:
        values, lengths = [], []
        for t in texts:
            document = split_words(t.as_py())
            wanted = sizes if not whole_if_shorter else [min(WINDOW, len(document))] if document else []
            found = {_digest(document[i : i + n]) for n in wanted for i in range(len(document) - n + 1)}
            values.extend(found)
            lengths.append(len(found))
        return list_array(pa.array(values, pa.int64()), np.array(lengths, np.int64))

    return hashed(text)


def _digest(window: list[bytes]) -> int:
    return int.from_bytes(sha256(b" ".join(window)).digest()[:8], "little", signed=True)


def _joined(df: DataFrame, bench: DataFrame, text: str, out: str) -> DataFrame:
    """The same for a benchmark of any size: texts meet items by window hash, then verify.

    Works on distinct texts. A window that many texts and many items share makes a pair of each
    of them, and all items of a text come together in one row, with their words.
    """
    lengths = bench.select(F.least(F.lit(WINDOW), F.size(F.array_remove(F.split(_spaced("words"), " +"), "")))
                           .alias("n")).distinct()
    sizes = sorted(r["n"] for r in lengths.collect() if r["n"] > 0)  # at most WINDOW numbers
    texts = df.select(F.col(text).alias("t")).where("t IS NOT NULL")
    texts = texts.withColumn("key", F.sha2("t", 256)).dropDuplicates(["key"])
    bench = bench.withColumn("item", F.sha2("words", 256))  # an id can be missing
    wanted = bench.select("item", F.explode(_windows_column(F.col("words"), True, sizes)).alias("w"))
    scanned = texts.select("key", F.explode(_windows_column(F.col("t"), False, sizes)).alias("w"))
    pairs = scanned.join(wanted, "w").select("key", "item").distinct().join(bench, "item")
    found = pairs.groupBy("key").agg(F.collect_set(F.struct("id", "words")).alias("items"))

    @F.arrow_udf(HITS)
    def verified(values: pa.Array, owners: pa.Array) -> pa.Array:
        rows = []
        for value, owner in zip(values, owners):
            listed = [(o["id"], split_words(o["words"])) for o in owner.as_py() or []]
            rows.append(judge(Windows.of(listed), value.as_py()))
        return pa.array(rows, judged_type())

    hits = texts.join(found, "key", "left").select("key", verified("t", "items").alias("__hits"))
    keyed = df.withColumn("__key", F.sha2(F.col(text), 256))
    joined = keyed.join(hits.withColumnRenamed("key", "__key"), "__key", "left")
    nothing = F.expr(f"CAST(named_struct('n_words', 0, 'n_hit', 0, 'longest', 0, 'items', array(), 'unnamed', false, 'spans', array()) AS {HITS})")
    return joined.withColumn(out, F.coalesce("__hits", nothing)).drop("__key", "__hits")


def _spaced(column: str) -> Column:
    return F.regexp_replace(F.col(column), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the given character spans."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(texts.to_pylist(), ranges.to_pylist()):
            if t and found:
                edges = [0, *(x for s in found for x in (s["start"], s["end"])), len(t)]
                t = "".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append(t)
        return pa.array(out, pa.string())

    return cut(text, spans)
