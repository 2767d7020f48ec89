"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped.

Words are numbered first: shards of the word's hash count them and write a file each, and the
more frequent a word of a shard, the smaller its number. Tasks then count n-grams of numbers per
slice of texts and send the distinct ones to shards of the context's key. A shard merges them,
writes its part of the order as one file of sorted keys to the shared folder, and passes each
distinct n-gram on to the next lower order, where it counts as one continuation; what is passed
on is stored, so that the shuffle behind it can go. Scoring tasks map the files, look up the
distinct n-grams of a slice in sorted order and interpolate from the lowest order up.

The model grows with the corpus and is never held by the driver or whole in memory; pages of
mapped files come and go with use. The shared folder has to be mounted as a path.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inductra.llm.chunks import MAX_SHARD_BITS, by_shard, packed, split_by_shard, unpacked
from inductra.llm.common import GOLDEN, forget, lower_ascii, mix, settle, store, utf8, word_hashes, words
from inductra.session import run_folder

#: Words of the longest n-gram.
ORDER = 3

#: Bytes of text a task counts or scores at once.
SLICE_BYTES = 8 << 20

#: Bytes of training text for each shard of an order.
SHARD_BYTES = 8 << 20

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)  # hashes of the marks around a text

#: The number of the mark before a text; words are numbered from 1.
START_ID = np.uint64(0)

#: The order of the words themselves, which are counted before all n-grams.
WORDS = 0

BLOB = "shard int, level int, size int, distinct int, words array<binary>, seen binary, sums array<double>"
BLOB_TYPE = pa.schema(
    [
        ("shard", pa.int32()),
        ("level", pa.int32()),
        ("size", pa.int32()),
        ("distinct", pa.int32()),
        ("words", pa.list_(pa.binary())),
        ("seen", pa.binary()),
        ("sums", pa.list_(pa.float64())),
    ]
)


@dataclass(frozen=True)
class Level:
    """Totals of one order: all seen, distinct n-grams, and discounts for counts 1, 2 and more."""

    total: float
    distinct: float
    discounts: tuple[float, float, float]
    once: tuple[float, float, float]  # n-grams seen once, twice, more often


@dataclass(frozen=True)
class Model:
    folder: str
    order: int
    bits: int  # of a key that name its shard
    id_bits: int = 0  # of a word's number
    levels: dict[int, Level] = field(default_factory=dict)
    files: frozenset[tuple[int, int]] = frozenset()  # (level, shard) that were written

    @property
    def train_tokens(self) -> int:
        return int(self.levels[WORDS].total) if WORDS in self.levels else 0

    @property
    def vocabulary(self) -> int:
        return int(self.levels[WORDS].distinct) if WORDS in self.levels else 0

    @property
    def unknown(self) -> int:
        """The number of a word that was not learned: the largest of ``id_bits``, which no word has."""
        return (1 << self.id_bits) - 1


def mounted(folder: str) -> str:
    """A folder's path on every machine."""
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError("memory-mapped models need spark.checkpoint.dir to be a mounted path")
    return parts.path


def tokens(raw: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of marks and words, and tokens of each text: order - 1 starts, the words, one end.

    A text's tokens are its words and the end.
    """
    start, end, of = words(raw, offsets)
    h = word_hashes(lower_ascii(raw), start, end)
    counts = np.bincount(of, minlength=len(offsets) - 1).astype(np.int64)
    lengths = counts + order
    ends = np.cumsum(lengths)
    flat = np.full(int(lengths.sum()), START, np.uint64)
    place = np.arange(len(h)) + np.repeat(ends - lengths + order - 1 - (np.cumsum(counts) - counts), counts)
    flat[place] = h
    flat[ends - 1] = END
    return flat, counts + 1


def grams(flat: np.ndarray, counts: np.ndarray, order: int, level: int) -> list[np.ndarray]:
    """The words of the ``level``-gram that ends at each token, first word first."""
    lengths = counts + order - 1
    is_token = np.ones(len(flat), bool)
    begins = np.cumsum(lengths) - lengths
    for i in range(order - 1):
        is_token[begins + i] = False
    at = np.flatnonzero(is_token)
    return [flat[at - i] for i in range(level - 1, -1, -1)]


def spread(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits mixed one to one within these bits, which then lead the 64 of a key."""
    half, mask = np.uint64((width + 1) // 2), np.uint64((1 << width) - 1)
    h = values ^ (values >> half)
    for odd in (GOLDEN, np.uint64(0xBF58476D1CE4E5B9)):
        h = (h * odd) & mask
        h ^= h >> half
    return h << np.uint64(64 - width)


def context_width(level: int, id_bits: int) -> int:
    return min(64, max(1, level - 1) * id_bits)


def gram_width(level: int, id_bits: int) -> int:
    return min(64, level * id_bits)


def context_keys(ws: list[np.ndarray], id_bits: int) -> np.ndarray:
    """Keys of all words but the last; of a single word, that word's, so that it has a shard.

    A key is the numbers themselves, mixed, where they fit in 64 bits, and else their hash.
    """
    ws = ws[:-1] or ws
    if len(ws) * id_bits <= 64:
        return spread(folded(ws, id_bits), len(ws) * id_bits)
    h = np.full(len(ws[0]), len(ws), np.uint64)
    for w in ws:
        h = mix(h * GOLDEN + w)
    return h


def gram_keys(context: np.ndarray, ws: list[np.ndarray], id_bits: int, bits: int) -> np.ndarray:
    """Keys of n-grams; the leading ``bits`` are the context's, so that both are in one shard."""
    if len(ws) == 1:
        return context
    shard = context >> np.uint64(64 - bits) << np.uint64(64 - bits)
    width = context_width(len(ws), id_bits) - bits
    if width + bits + id_bits <= 64:
        rest = (context << np.uint64(bits)) >> np.uint64(64 - width)
        below = spread(folded([rest, ws[-1]], id_bits), width + id_bits)
    else:
        below = mix(context * GOLDEN + ws[-1])
    return shard | (below >> np.uint64(bits))


def folded(ws: list[np.ndarray], id_bits: int) -> np.ndarray:
    out = ws[0]
    for w in ws[1:]:
        out = (out << np.uint64(id_bits)) | w
    return out


def merged(ws: list[np.ndarray], seen: np.ndarray | None, id_bits: int = 64) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams in order of their words, and the sums of their counts; without counts, each is one."""
    at_once = 64 // id_bits
    if seen is None and len(ws) <= at_once:
        # Numbers that fit in 64 bits are sorted themselves and taken apart again.
        ranked = np.sort(folded(ws, id_bits))
        head = heads(ranked)
        low, mask = ranked[head], np.uint64((1 << id_bits) - 1)
        shifts = [np.uint64(id_bits * i) for i in range(len(ws) - 1, -1, -1)]
        return [(low >> shift) & mask for shift in shifts], np.diff(head, append=len(ranked))
    if seen is None:
        seen = np.ones(len(ws[0]), np.int64)
    if len(seen) == 0:
        return ws, seen
    columns = [folded(ws[i : i + at_once], id_bits) for i in range(0, len(ws), at_once)]
    order = np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])
    head = heads(*(c[order] for c in columns))
    first = order[head]
    return [w[first] for w in ws], np.add.reduceat(seen[order], head)


def heads(*ranked: np.ndarray) -> np.ndarray:
    """Where sorted columns begin another row."""
    fresh = np.ones(len(ranked[0]), bool)
    fresh[1:] = False
    for c in ranked:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def place_type(distinct: int):
    return np.uint16 if distinct <= 1 << 16 else np.uint32


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers compressed byte by byte, so that their equal leading bytes stand together."""
    return packed(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def from_planes(data: bytes, size: int) -> np.ndarray:
    return np.ascontiguousarray(unpacked(data, size * 8).reshape(8, -1).T).view("<u8").ravel()


def word_columns(ws: list[np.ndarray]) -> dict:
    """The words of n-grams as a list of the distinct ones and places in it, each column compressed.

    Rare words make most of a blob; of the sorted list only the steps are sent.
    """
    known, places = np.unique(np.concatenate(ws), return_inverse=True)
    places = places.astype(place_type(len(known))).reshape(len(ws), -1)
    return {"distinct": len(known), "words": [planes(np.diff(known, prepend=np.uint64(0))), *map(packed, places)]}


def words_of(columns: list[bytes], distinct: int, size: int) -> list[np.ndarray]:
    known = np.cumsum(from_planes(columns[0], distinct), dtype=np.uint64)
    return [known[unpacked(c, size, place_type(distinct))] for c in columns[1:]]


def blobs(model: Model, ws: list[np.ndarray], seen: np.ndarray) -> list[dict]:
    """Rows for the shards of n-grams that are in order of their words; each column is compressed."""
    context = context_keys(ws, model.id_bits)
    order = np.argsort((context >> np.uint64(64 - model.bits)).astype(np.uint16), kind="stable")
    ws, seen = [w[order] for w in ws], seen[order]
    return [
        {
            "shard": shard,
            "level": len(ws),
            "size": at.stop - at.start,
            "words": [planes(np.diff(ws[0][at], prepend=np.uint64(0))), *(planes(w[at]) for w in ws[1:])],
            "seen": planes(seen[at]),
        }
        for shard, at in split_by_shard(context[order], model.bits)
    ]


def word_blobs(hashes: np.ndarray, seen: np.ndarray, bits: int) -> list[dict]:
    """Rows for the shards of words, given as sorted hashes."""
    return [
        {
            "shard": shard,
            "level": WORDS,
            "size": at.stop - at.start,
            **word_columns([hashes[at]]),
            "seen": planes(seen[at]),
        }
        for shard, at in split_by_shard(hashes, bits)
    ]


def slices_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about ``SLICE_BYTES``."""
    raw, offsets = utf8(texts)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield start, end, raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


# Files: numbers of grams, contexts and large counts, bits of the shard, widths of both keys and of extra numbers; large
# counts behind their places in the row of all counts; keys of grams and of contexts; extra numbers of grams; counts:
# grams seen, sums and kinds of contexts. A count is half a byte; ``LARGE`` means that the large counts have it.

LARGE = 15

#: Keys of a bucket, about.
BUCKET = 8


def file_of(folder: str, level: int, shard: int) -> str:
    return os.path.join(folder, f"{level}-{shard:05d}.grams")


def key_form(n: int, width: int, bits: int) -> tuple[int, int]:
    """(bits that name a bucket, bytes that are stored) of n keys of ``width`` bits in one shard.

    Leading bits that the bucket tells are not stored, but for those that fill a byte.
    """
    buckets = min(width - bits, max(0, (n // BUCKET).bit_length() - 1))
    return buckets, max(1, -(-(width - bits - buckets) // 8))


def key_parts(keys: np.ndarray, width: int, bits: int, buckets: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each key, and what is stored of it."""
    below = keys << np.uint64(bits)
    bucket = (below >> np.uint64(64 - buckets)).astype(np.int64) if buckets else np.zeros(len(keys), np.int64)
    return bucket, (below >> np.uint64(64 - width + bits)) & np.uint64((1 << 8 * size) - 1)


def write_file(
    path: str,
    grams: np.ndarray,
    contexts: np.ndarray,
    counts: list[np.ndarray],
    bits: int = 0,
    widths: tuple[int, int] = (64, 64),
    extra: np.ndarray | None = None,
) -> None:
    """Write a file under another name and move it in place: a repeated task ends the same way.

    ``grams`` and ``contexts`` are sorted distinct keys of one shard.
    """
    os.makedirs(os.path.dirname(path), exist_ok=True)
    listed = np.concatenate(counts).astype(np.int64)
    large = np.flatnonzero(listed >= LARGE)
    halves = np.append(np.minimum(listed, LARGE), 0).astype(np.uint8)
    halves = halves[: len(halves) & ~1]
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as file:
        extras = np.zeros(0, np.uint32) if extra is None else extra.astype(np.uint32)
        file.write(np.array([len(grams), len(contexts), len(large), bits, *widths, len(extras)], np.int64).tobytes())
        for a in (large, listed[large], extras):
            file.write(a.tobytes())
        for keys, width in zip((grams, contexts), widths):
            buckets, size = key_form(len(keys), width, bits)
            bucket, low = key_parts(keys, width, bits, buckets, size)
            file.write(np.searchsorted(bucket, np.arange((1 << buckets) + 1)).astype(np.uint32).tobytes())
            file.write(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes() + bytes(8))
        file.write((halves[::2] | (halves[1::2] << np.uint8(4))).tobytes())
    os.replace(part, path)


class Keys:
    """Sorted keys in a mapped file."""

    def __init__(self, part: Part, n: int, width: int, bits: int):
        self.n, self.width, self.bits = n, width, bits
        self.buckets, self.size = key_form(n, width, bits)
        self.starts = part.next((1 << self.buckets) + 1, np.uint32)
        raw = part.next(n * self.size + 8, np.uint8)
        # Each entry is read with bytes of those behind it, which are masked.
        self.low = np.ndarray((n + 1,), "<u8", raw, strides=(self.size,))
        self.mask = np.uint64((1 << 8 * self.size) - 1)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For keys of this shard: the place of each, and whether it is there. """
        bucket, low = key_parts(wanted, self.width, self.bits, self.buckets, self.size)
        first, end = self.starts[bucket].astype(np.int64), self.starts[bucket + 1].astype(np.int64)
        step = 1 << int((end - first).max(initial=0)).bit_length() >> 1
        while step:
            last = first + (step - 1)
            first += step * ((last < end) & ((self.low[np.minimum(last, self.n)] & self.mask) < low))
            step >>= 1
        return first, (first < end) & ((self.low[first] & self.mask) == low)


class Part:
    """One mapped file."""

    def __init__(self, path: str, level: int):
        self.data = np.memmap(path, np.uint8, "r")
        self.at = 56
        n, k, m, bits, wide, wide_context, extras = self.data[:56].view(np.int64).tolist()
        self.large, self.large_counts = self.next(m, np.int64), self.next(m, np.int64)
        self.extra = self.next(extras, np.uint32)
        self.grams = Keys(self, n, wide, bits)
        self.contexts = Keys(self, k, wide_context, bits)
        self.counts = self.data[self.at :]

    def count(self, place: np.ndarray) -> np.ndarray:
        """The counts at places in the row of all counts."""
        out = ((self.counts[place >> 1] >> ((place & 1) << 2).astype(np.uint8)) & np.uint8(15)).astype(np.int64)
        at = np.flatnonzero(out == LARGE)
        out[at] = self.large_counts[np.searchsorted(self.large, place[at])]
        return out

    def next(self, n: int, kind) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        out = self.data[self.at : self.at + size].view(kind)
        self.at += size
        return out


def summary(level: int, shard: int, seen: np.ndarray) -> dict:
    """A row of what a shard adds to the totals of its order."""
    sums = [float((seen == i).sum()) for i in range(1, 5)] + [float(seen.sum()), float(len(seen)), float(shard)]
    return {"shard": -1, "level": level, "size": 0, "sums": sums}


def build_words(shard: int, model: Model, rows: pa.Table) -> list[dict]:
    """Count and number the words of a shard and write its file."""
    listed = zip(rows.column("words").to_pylist(), rows.column("distinct").to_pylist(), rows.column("size").to_pylist())
    hashes = np.concatenate([words_of(*row)[0] for row in listed])
    (hashes,), seen = merged([hashes], counts_of(rows))
    rank = np.empty(len(seen), np.uint32)
    rank[np.argsort(-seen, kind="stable")] = np.arange(len(seen), dtype=np.uint32)
    write_file(file_of(model.folder, WORDS, shard), hashes, hashes[:0], [seen], model.bits, extra=rank)
    return [summary(WORDS, shard, seen)]


def counts_of(rows: pa.Table) -> np.ndarray:
    sizes = rows.column("size").to_pylist()
    return np.concatenate([from_planes(v, n) for v, n in zip(rows.column("seen").to_pylist(), sizes)]).astype(np.int64)


def build_shard(level: int, shard: int, model: Model, rows: pa.Table) -> list[dict]:
    """Merge the n-grams of a shard, write its file, and return rows for the next lower order."""
    sizes, listed = rows.column("size").to_pylist(), rows.column("words").to_pylist()
    ws = [np.concatenate([np.cumsum(from_planes(v[0], n), dtype=np.uint64) for v, n in zip(listed, sizes)])]
    ws.extend(np.concatenate([from_planes(v[i], n) for v, n in zip(listed, sizes)]) for i in range(1, level))
    ws, seen = merged(ws, counts_of(rows), model.id_bits)
    context = context_keys(ws, model.id_bits)
    keys = gram_keys(context, ws, model.id_bits, model.bits)
    order = np.argsort(keys)
    counts = [seen[order]]
    contexts = np.zeros(0, np.uint64)
    if level > 1:
        by = np.argsort(context)
        head = heads(context[by])
        contexts, c = context[by[head]], seen[by]
        counts.extend(np.add.reduceat(k.astype(np.int64), head) for k in (c, c == 1, c == 2, c > 2))
    widths = gram_width(level, model.id_bits), context_width(level, model.id_bits)
    write_file(file_of(model.folder, level, shard), keys[order], contexts, counts, model.bits, widths)
    out = [summary(level, shard, seen)]
    if level > 1:
        out.extend(blobs(model, *merged(ws[1:], None, model.id_bits)))
    return out


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, BLOB_TYPE)


def fit(df: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """Count a model over all texts of ``df``; a missing text is an empty one, with one token.

    Texts are lower-cased (A-Z) and cut at blanks and control characters. Repeated rows count
    each. An empty table gives a model that knows no words.
    """
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = min(MAX_SHARD_BITS, max(1, int(size // SHARD_BYTES).bit_length()))
    model = Model(mounted(run_folder(spark, "lm")), order, bits)
    texts = df.select(F.col(text).alias("text"))

    def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in slices_of(batch.column(0)):
                yield batch_of(word_blobs(*np.unique(tokens(raw, offsets, 1)[0], return_counts=True), bits))

    def build_numbers(shard: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        yield batch_of(build_words(shard, model, rows))

    known = store(by_shard(texts.mapInArrow(count_words, BLOB), build_numbers, BLOB), "lm-words")
    most = known.agg(F.max(F.col("sums")[5])).first()[0] or 0
    # The largest number of all stands for unknown words.
    model = replace(with_totals(model, known), id_bits=((int(most) << bits) + 1).bit_length())
    forget(known)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in slices_of(batch.column(0)):
                flat, counts = tokens(raw, offsets, order)
                words, back = np.unique(flat, return_inverse=True)
                ws = grams(numbers(model, words)[0][back], counts, order, order)
                yield batch_of(blobs(model, *merged(ws, None, model.id_bits)))

    rows, before = texts.mapInArrow(count, BLOB), None
    for level in range(order, 0, -1):

        def build(shard: int, rows: pa.Table, level: int = level, model: Model = model) -> Iterator[pa.RecordBatch]:
            yield batch_of(build_shard(level, shard, model, rows))

        built = store(by_shard(rows, build, BLOB), f"lm-{level}")
        rows = built.where("shard >= 0")
        model = with_totals(model, built)
        if before is not None:
            forget(before)
        else:
            settle(spark)
        before = built
    forget(before)
    return model


def with_totals(model: Model, built: DataFrame) -> Model:
    """The model with the totals of an order whose files were written."""
    parts = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(6)]
    # One entry per file, a few bytes each.
    parts.append(F.collect_list(F.col("sums")[6].cast("int")).alias("shards"))
    levels, files = dict(model.levels), set(model.files)
    for r in built.where("shard < 0").groupBy("level").agg(*parts).collect():
        files.update((r["level"], shard) for shard in r["shards"])
        n1, n2, n3, n4, total, distinct = (r[f"s{i}"] for i in range(6))
        levels[r["level"]] = Level(total, distinct, discounts(n1, n2, n3, n4), (n1, n2, distinct - n1 - n2))
    return replace(model, levels=levels, files=frozenset(files))


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """What is taken off counts of one, two and more, from the numbers of n-grams seen 1 to 4 times.

    Where a small corpus lacks one of these numbers, the discount of the rank below is kept
    within its count.
    """
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2 if n3 else d1
    d3 = 3 - 4 * y * n4 / n3 if n3 and n4 else d2
    return min(max(d1, 0.05), 0.99), min(max(d2, 0.05), 1.99), min(max(d3, 0.05), 2.99)


def discount(level: Level, seen: np.ndarray) -> np.ndarray:
    d = np.array([0.0, *level.discounts])
    return d[np.minimum(seen, 3).astype(np.int64)]


def parts_of(model: Model, level: int, keys: np.ndarray) -> Iterator[tuple[int, Part, slice]]:
    """The files that sorted keys may be in, each with the slice of its keys."""
    for shard, at in split_by_shard(keys, model.bits):
        # A file that was written and cannot be seen here is an error, not an unknown n-gram.
        if (level, shard) in model.files:
            yield shard, Part(file_of(model.folder, level, shard), level), at


def find(model: Model, level: int, keys: np.ndarray, kind: str) -> list[np.ndarray]:
    """Values of sorted distinct keys of n-grams (seen) or contexts (total, kinds); 0 if unknown."""
    out = [np.zeros(len(keys), np.int64) for _ in range(1 if kind == "gram" else 4)]
    for _, part, at in parts_of(model, level, keys):
        known = part.grams if kind == "gram" else part.contexts
        place, hit = known.find(keys[at])
        place, to = place[hit], np.arange(at.start, at.stop)[hit]
        begin = 0 if kind == "gram" else part.grams.n
        for i, values in enumerate(out):
            values[to] = part.count(begin + i * known.n + place)
    return out


def numbers(model: Model, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of sorted distinct hashes of words and marks, and how often each was seen in training."""
    ids, seen = np.full(len(distinct), model.unknown, np.uint64), np.zeros(len(distinct), np.int64)
    for shard, part, at in parts_of(model, WORDS, distinct):
        place, hit = part.grams.find(distinct[at])
        place, to = place[hit], np.arange(at.start, at.stop)[hit]
        ids[to] = (part.extra[place].astype(np.uint64) << np.uint64(model.bits)) + np.uint64(shard + 1)
        seen[to] = part.count(place)
    ids[distinct == START] = START_ID
    return ids, seen


def score_slice(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(tokens, known tokens, base score, model score) of each text."""
    flat, counts = tokens(raw, offsets, model.order)
    begins = np.cumsum(counts) - counts
    distinct, back = np.unique(flat, return_inverse=True)
    ids, raw_counts = numbers(model, distinct)
    unigram, n, v = model.levels[1], model.train_tokens, model.vocabulary
    singles = context_keys([ids], model.id_bits)
    seen = values(model, 1, singles, "gram")[0]
    left = sum(d * k for d, k in zip(unigram.discounts, unigram.once)) / unigram.total
    # Values of single words are looked up once per word and dealt out to its places.
    places = grams(back, counts, model.order, model.order)
    last = places[-1]
    p = ((seen - discount(unigram, seen)) / unigram.total + left / (v + 1))[last]
    base = np.log10((raw_counts + 0.5) / (n + 0.5 * (v + 1)))[last]
    known = (raw_counts > 0)[last]
    for level in range(2, model.order + 1):
        totals = model.levels[level]
        ws = [ids[at] for at in places[-level:]]
        context = context_keys(ws, model.id_bits)
        seen = values(model, level, gram_keys(context, ws, model.id_bits, model.bits), "gram")[0]
        if level == 2:
            kinds = [k[places[-2]] for k in values(model, level, singles, "context")]
        else:
            kinds = values(model, level, context, "context")
        total, once, twice, more = kinds
        d1, d2, d3 = totals.discounts
        held = total > 0
        safe = np.where(held, total, 1)
        own = (seen - discount(totals, seen)) / safe
        p = np.where(held, own + (d1 * once + d2 * twice + d3 * more) / safe * p, p)
    return (
        counts,
        np.add.reduceat(known.astype(np.int64), begins),
        np.add.reduceat(base, begins),
        np.add.reduceat(np.log10(p), begins),
    )


def values(model: Model, level: int, keys: np.ndarray, kind: str) -> list[np.ndarray]:
    distinct, back = np.unique(keys, return_inverse=True)
    return [v[back] for v in find(model, level, distinct, kind)]


SCORES = "struct<n_tokens: bigint, n_known: bigint, base_score: double, score: double>"


def score(text, model: Model):
    """A struct (n_tokens, n_known, base_score, score) of a text; scores are log10 probabilities.

    ``base_score`` is that of a unigram model with half a count added. A missing text is empty:
    its only token is the end. Row by row, whole texts of any length.
    """

    @F.arrow_udf(SCORES)
    def scored(texts: pa.Array) -> pa.Array:
        parts = []
        for start, end, raw, offsets in slices_of(texts):
            if model.train_tokens:
                parts.append(score_slice(model, raw, offsets))
            else:
                counts = tokens(raw, offsets, 1)[1]
                zero = np.zeros(len(counts))
                parts.append((counts, zero.astype(np.int64), zero, zero))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * 4
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = ("n_tokens", "n_known", "base_score", "score")
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return scored(text)
