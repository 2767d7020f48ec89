"""Removal of passages that an earlier document holds, by suffix orders.

Every window of ``WINDOW`` bytes belongs to its anchor, the inner k-mer with the smallest
hash; windows side by side with one anchor form a run. Equal windows have equal anchors, so
only runs whose anchor occurs in several documents need a closer look. Runs with one anchor
form a text of distinct strings; its suffixes are ordered by linear grouping, equal windows
stand side by side, and the smallest document among them is their first. A window is
removed where its document is not the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inductra.llm.chunks import (
    NO_ID,
    Chunk,
    by_shard,
    chunk_table,
    each_answered,
    is_in,
    packed,
    shard_bits,
    shared_flags,
    shared_hashes,
    split_by_shard,
    unpacked,
)
from inductra.llm.common import GOLDEN, forget, mix, ragged, settle, store
from inductra.llm.lyndon import suffix_order

#: Bytes of a passage, and of an anchor inside it.
WINDOW = 50
ANCHOR = 16

#: Bytes of strings ordered together in one pass, for the processor's cache.
BATCH = 1 << 17
#: Bytes of strings with one anchor above which other anchors split them further.
LONG = 1 << 14
#: Times that is tried.
SPLITS = 6

#: Windows worked on at once, for the processor's cache.
PIECE = 1 << 16

#: The bits of a k-mer's rank that hold its place in a piece; the others lead its hash.
PLACES = np.uint64((1 << 18) - 1)

MIXER = np.uint64(0xD6E8FEB86659FD93)

#: The bits beside a window's hash that hold the number of its string.
NUMBERS = 24
#: Keys of windows looked at in one go, about.
KEYS = 1 << 19


def words_at(raw: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """The 8 bytes from each place on, as numbers; ``raw`` has 8 spare bytes at its end."""
    view = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    return view[at]


def runs(raw: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (first window, windows, anchor hash, text index).

    ``seed`` picks the order of anchors. Windows never cross texts. Bytes are worked on in
    pieces that stay in the processor's cache; a run that goes on in the next piece is one.
    """
    empty = np.zeros(0, np.int64)
    size = len(raw) - WINDOW + 1
    lengths = np.diff(offsets)
    held = lengths >= WINDOW
    if size < 1 or not held.any():
        return empty, empty, empty.astype(np.uint64), empty
    edges = np.zeros(size + 1, np.int8)
    edges[offsets[:-1][held]] += 1
    edges[offsets[1:][held] - WINDOW + 1] -= 1
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    found, before, inside = [], -1, False
    for start in range(0, size, PIECE):
        end = min(size, start + PIECE)
        anchor, hashes = anchors(padded[start : end + WINDOW + 7], seed)
        anchor += start
        valid = np.cumsum(edges[start:end], dtype=np.int8) + np.int8(inside) > 0
        changed = np.empty(end - start, bool)
        changed[0] = anchor[0] != before or not inside
        changed[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        first = np.flatnonzero(changed & valid)
        # The smallest hashes crowd at the low end; mixed again they spread over all shards.
        found.append((first + start, mix(hashes[anchor[first] - start])))
        before, inside = anchor[-1], bool(valid[-1])
    first = np.concatenate([f for f, _ in found])
    of = np.searchsorted(offsets, first, side="right") - 1
    stop = offsets[of + 1] - WINDOW + 1
    count = np.minimum(np.append(first[1:], size), stop) - first
    return first, count, np.concatenate([h for _, h in found]), of


def anchors(padded: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each window's anchor, and the hash of every inner k-mer.

    The leftmost k-mer with the smallest leading bits wins; ``padded`` has 8 spare bytes.
    """
    grams = len(padded) - 8 - ANCHOR + 1
    hashes = words_at(padded, slice(0, grams)) * GOLDEN
    hashes ^= words_at(padded, slice(8, grams + 8)) * MIXER
    hashes += np.uint64(seed)
    hashes ^= hashes >> np.uint64(32)
    hashes *= MIXER
    hashes ^= hashes >> np.uint64(29)
    hashes *= GOLDEN
    low = hashes & ~PLACES
    low |= np.arange(grams, dtype=np.uint64)
    span, wanted = 1, WINDOW - ANCHOR + 1
    while span * 2 <= wanted:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wanted:
        low = np.minimum(low[: -(wanted - span)], low[wanted - span :])
    return (low & PLACES).astype(np.int64), hashes


def first_owners(raw: np.ndarray, lengths: np.ndarray, anchors: np.ndarray, owners: np.ndarray, seed: int = 0) -> np.ndarray:
    """The smallest owner of every window of distinct strings, string after string.

    Windows are equal only if their strings have the same anchor.
    """
    windows = np.maximum(lengths - WINDOW + 1, 0)
    out = np.repeat(owners, windows)
    if len(out) == 0:
        return out
    order = np.argsort(anchors, kind="stable")
    ranked = anchors[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    bytes_of = np.add.reduceat(lengths[order], head)
    starts, begins = np.cumsum(lengths) - lengths, np.cumsum(windows) - windows
    lane = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
    long = (bytes_of > LONG) & (seed < SPLITS)

    def strings(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = order[chosen]
        return at, raw[ragged(starts[at], lengths[at])], ragged(begins[at], windows[at])

    # Strings whose anchor has many others: split them by anchors of another order.
    at, text, places = strings(np.flatnonzero(long[lane]))
    if len(at):
        offsets = np.concatenate([[0], np.cumsum(lengths[at])])
        first, count, inner, of = runs(text, offsets, seed + 1)
        both = mix(inner ^ anchors[at][of] * GOLDEN)
        out[places] = _owners_of_runs(text, first, count, both, owners[at][of], seed + 1)
    # A single string is its own order: all its windows have its owner, as ``out`` says already.
    several = np.diff(np.append(head, len(order))) > 1
    by_size = np.argsort(bytes_of, kind="stable")
    by_size = by_size[(several & ~long)[by_size]]
    batch = np.cumsum(bytes_of[by_size]) // BATCH
    cuts = np.flatnonzero(np.diff(batch)) + 1
    lane_start = np.append(head, len(order))
    for lanes in np.split(by_size, cuts):
        if len(lanes) == 0:
            continue
        counts = lane_start[lanes + 1] - lane_start[lanes]
        at, text, places = strings(ragged(lane_start[lanes], counts))
        out[places] = _ordered_owners(text, lengths[at], np.repeat(np.arange(len(lanes)), counts), owners[at])
    return out


def _owners_of_runs(raw, first, count, anchors, owners, seed) -> np.ndarray:
    """Smallest owners by window for runs that may repeat: equal strings are put together first.

    Strings that share no window with another owner's keep their own and are not ordered.
    """
    lengths = count + WINDOW - 1
    number, distinct, smallest = distinct_strings(raw, first, lengths, owners)
    flat = raw[ragged(first[distinct], lengths[distinct])]
    found = np.repeat(smallest, count[distinct])
    mixed = meets_others(flat, lengths[distinct], smallest)
    part = flat[np.repeat(mixed, lengths[distinct])]
    left = distinct[mixed]
    found[np.repeat(mixed, count[distinct])] = first_owners(part, lengths[left], anchors[left], smallest[mixed], seed)
    begins = np.cumsum(count[distinct]) - count[distinct]
    return found[ragged(begins[number], count)]


def meets_others(raw: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Which strings have a window that a string of another owner has too, by hashes of windows.

    Equal windows have equal hashes, so none is missed; a few may be named without need.
    """
    if len(lengths) < 2 or len(lengths) >> NUMBERS:
        return np.ones(len(lengths), bool)
    low = np.uint64((1 << NUMBERS) - 1)
    inside = np.zeros(len(raw) + 1, np.int8)
    starts = np.cumsum(lengths) - lengths
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + lengths - WINDOW + 1, -1)
    keys = window_hashes(raw)[np.cumsum(inside[: len(raw) - WINDOW + 1], dtype=np.int8).view(bool)]
    keys &= ~low
    keys |= np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths - WINDOW + 1)
    keys.sort()
    out = np.zeros(len(lengths), bool)
    start = 0
    # In pieces, each up to the end of a hash, so that what is made from the keys stays small.
    while start < len(keys):
        end = min(len(keys), start + KEYS)
        end = int(np.searchsorted(keys, keys[end - 1] | low, side="right"))
        part = keys[start:end]
        hashes = part >> np.uint64(NUMBERS)
        head = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        string = (part & low).view(np.int64)
        owner = owners[string]
        several = np.minimum.reduceat(owner, head) < np.maximum.reduceat(owner, head)
        out[string[np.repeat(several, np.diff(np.append(head, len(part))))]] = True
        start = end
    return out


def window_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``WINDOW`` bytes from each place on."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    out = np.empty(len(raw) - WINDOW + 1, np.uint64)
    for start in range(0, len(out), PIECE):
        end = min(len(out), start + PIECE)
        h = np.zeros(end - start, np.uint64)
        for step in [*range(0, WINDOW - 8, 8), WINDOW - 8]:
            h ^= words_at(padded, slice(start + step, end + step))
            h *= GOLDEN
            h ^= h >> np.uint64(29)
        out[start:end] = h * MIXER
    return out


def distinct_strings(raw: np.ndarray, first: np.ndarray, lengths: np.ndarray, owners: np.ndarray):
    """(number of each string, one place of each distinct string, its smallest owner)."""
    data = raw.tobytes()
    known: dict[bytes, int] = {}
    number = np.fromiter(
        (known.setdefault(data[a:b], len(known)) for a, b in zip(first.tolist(), (first + lengths).tolist())),
        np.int64,
        len(first),
    )
    distinct = np.zeros(len(known), np.int64)
    distinct[number[::-1]] = np.arange(len(number))[::-1]
    smallest = np.full(len(known), NO_ID, np.int64)
    np.minimum.at(smallest, number, owners)
    return number, distinct, smallest


def _ordered_owners(text: np.ndarray, lengths: np.ndarray, lane: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Smallest owners by window, from the suffix order of each lane's strings joined by marks."""
    marked = lengths + 1
    starts = np.cumsum(marked) - marked
    symbols = np.zeros(int(marked.sum()), np.int16)
    at = ragged(starts, lengths)
    symbols[at] = text.astype(np.int16) + 1
    lane_lengths = np.bincount(lane, weights=marked).astype(np.int64)
    order = suffix_order(symbols, lane_lengths)
    windows = np.maximum(lengths - WINDOW + 1, 0)
    begin = np.full(len(symbols), -1, np.int64)
    places = ragged(starts, windows)
    begin[places] = np.arange(len(places))
    owner = np.repeat(owners, windows)
    order = order[begin[order] >= 0]
    padded = np.zeros(len(symbols) + 8, np.uint8)
    padded[at] = text
    same = np.repeat(lane, windows)[begin[order]]
    same = same[1:] == same[:-1]
    for step in [*range(0, WINDOW - 8, 8), WINDOW - 8]:
        part = words_at(padded, order + step)
        same &= part[1:] == part[:-1]
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    ranked = begin[order]
    least = np.minimum.reduceat(owner[ranked], head)
    out = np.empty(len(owner), np.int64)
    out[ranked] = np.repeat(least, np.diff(np.append(head, len(ranked))))
    return out


def anchor_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    _, ids, raw, offsets = chunk
    _, _, hashes, of = runs(raw, offsets)
    return hashes, ids[of]


def shared_runs(chunk: Chunk, bits: int, answers: dict[int, tuple]):
    """The runs of a chunk whose anchor is shared, and their distinct strings."""
    _, ids, raw, offsets = chunk
    first, count, hashes, of = runs(raw, offsets)
    kept = is_in(hashes, shared_hashes(hashes, bits, answers))
    first, count, hashes, owners = first[kept], count[kept], hashes[kept], ids[of[kept]]
    number, distinct, smallest = distinct_strings(raw, first, count + WINDOW - 1, owners)
    return first, count, hashes, owners, number, distinct, smallest


def find_repeats(chunks: DataFrame, bits: int) -> DataFrame:
    """Stored rows (chunk, shard, shared, number, owners): first owners of the windows of shared runs.

    ``number`` lists the distinct strings of the chunk that a shard answers for, ``owners``
    the first owner of each of their windows. No shuffle file is left behind.
    """
    flags = store(shared_flags(chunks, bits, anchor_hashes), "shared-anchors")
    settle(chunks.sparkSession)

    def ask(chunk: Chunk, answers: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        _, _, raw, _ = chunk
        first, count, hashes, _, _, distinct, smallest = shared_runs(chunk, bits, answers)
        order = np.argsort(hashes[distinct], kind="stable")
        places, least = distinct[order], smallest[order]
        lengths = count[places] + WINDOW - 1
        rows = []
        for shard, at in split_by_shard(hashes[places], bits):
            text = raw[ragged(first[places[at]], lengths[at])]
            sent = (least[at], lengths[at].astype(np.uint8), text)
            rows.append((shard, at.stop - at.start, len(text), order[at].astype(np.int32).tobytes(), *map(packed, sent)))
        kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([chunk[0]] * len(rows), pa.int64()),
                *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)),
            ],
            ["chunk", "shard", "size", "n_bytes", "number", "owners", "lengths", "strings"],
        )

    def answer(shard: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes = rows.column("size").to_pylist()

        def column(name: str, kind, sizes: list[int]) -> np.ndarray:
            return np.concatenate([unpacked(v.as_py(), n, kind) for v, n in zip(rows.column(name), sizes)])

        lengths = column("lengths", np.uint8, sizes).astype(np.int64)
        owners = column("owners", np.int64, sizes)
        raw = column("strings", np.uint8, rows.column("n_bytes").to_pylist())
        # A string is one run, so these are the anchors it was sent for.
        _, _, anchors, _ = runs(raw, np.concatenate([[0], np.cumsum(lengths)]))
        first = np.cumsum(lengths) - lengths
        windows = lengths - WINDOW + 1
        found = _owners_of_runs(raw, first, windows, anchors, owners, 0)
        ends = np.cumsum(windows)
        chunks, numbers = rows.column("chunk").to_pylist(), rows.column("number").to_pylist()
        at, out = 0, []
        for size in sizes:
            a, b = (ends[at - 1] if at else 0), (ends[at + size - 1] if size else 0)
            out.append(found[a:b])
            at += size
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(chunks, pa.int64()),
                pa.array([shard] * len(out), pa.int32()),
                pa.array(numbers, pa.binary()),
                pa.array([pack_runs(o) for o in out], pa.binary()),
            ],
            ["chunk", "shard", "number", "owners"],
        )

    asked = each_answered(
        chunks,
        flags,
        ask,
        "chunk bigint, shard int, size int, n_bytes int, number binary, owners binary, lengths binary, strings binary",
    )
    found = by_shard(asked, answer, "chunk bigint, shard int, number binary, owners binary")
    answers = store(flags.join(found, ["chunk", "shard"], "left"), "first-owners", "zstd")
    forget(flags)
    return answers


def pack_runs(values: np.ndarray) -> bytes:
    """Values as (length, value) pairs of equal neighbours."""
    if len(values) == 0:
        return b""
    head = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return np.stack([np.diff(np.append(head, len(values))), values[head]]).astype(np.int64).tobytes()


def unpack_runs(data: bytes) -> np.ndarray:
    pairs = np.frombuffer(data, np.int64).reshape(2, -1)
    return np.repeat(pairs[1], pairs[0])


REMOVED = "row_id bigint, text_sha256 binary, kept binary, n_bytes bigint, n_spans bigint"


def remove_repeats(
    df: DataFrame, text: str = "text", row_id: str = "doc_id", whole: bool = False, rest: list[str] | None = None
) -> DataFrame:
    """(row id, text_sha256, kept, n_bytes, n_spans): the bytes of every text that stay.

    Goes byte by byte: removed is each byte covered by ``WINDOW`` bytes that also start in a
    document with a smaller id, as the input stands. ``kept`` are the other bytes, which may
    break a character; with ``whole`` they are text, as ``whole_characters`` makes it, but read
    where they are cut, chunk by chunk. ``n_spans`` counts the removed stretches, ``text_sha256`` is the digest
    of the text as it was, which tells rows of one id apart. Missing texts are empty. Rows
    of one id never remove each other's passages; a missing id is larger than all. With ``rest``,
    a further column of that name is a struct of the row's values of these columns, which go
    along with the text, so that nothing has to be joined. An empty table gives no rows.
    """
    chunks = chunk_table(df, text, row_id, rest)
    bits = shard_bits(chunks)
    answers = find_repeats(chunks, bits)
    read = readable if whole else bytes

    def cut(chunk: Chunk, found: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        _, ids, raw, offsets = chunk
        first, count, _, owners, number, distinct, _ = shared_runs(chunk, bits, found)
        counts = count[distinct]
        # Arrays with an entry for each window or byte are dropped as soon as they are used.
        least = np.full(int(counts.sum()), NO_ID, np.int64)
        begins = np.cumsum(counts) - counts
        for _, numbers, values in found.values():
            if numbers:
                numbers = np.frombuffer(numbers, np.int32)
                least[ragged(begins[numbers], counts[numbers])] = unpack_runs(values)
        repeated = least[ragged(begins[number], count)] < np.repeat(owners, count)
        del least
        places = ragged(first, count)[repeated]
        edges = np.zeros(len(raw) + 1, np.int32)
        np.add.at(edges, places, 1)
        places += WINDOW
        np.add.at(edges, places, -1)
        del places, repeated
        gone = np.cumsum(edges[:-1], dtype=np.int32) > 0
        del edges
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(raw)]
        starts[inner] = gone[inner]
        sums = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(starts, out=sums[1:])
        spans = sums[offsets]
        np.cumsum(~gone, out=sums[1:])
        at = sums[offsets].tolist()
        del sums, starts
        kept = raw[~gone].tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64(), mask=ids == NO_ID),
                pa.array([sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary()),
                pa.array([read(kept[a:b]) for a, b in zip(at[:-1], at[1:])], pa.string() if whole else pa.binary()),
                pa.array(np.diff(offsets), pa.int64()),
                pa.array(np.diff(spans), pa.int64()),
            ],
            ["row_id", "text_sha256", "kept", "n_bytes", "n_spans"],
        )

    schema = REMOVED.replace("kept binary", "kept string") if whole else REMOVED
    out = each_answered(chunks, answers, cut, schema, rest=bool(rest))
    return out.withColumnRenamed("row_id", row_id)


def readable(kept: bytes) -> str:
    return kept.decode("utf-8", "ignore")


def whole_characters(kept: Column) -> Column:
    """Kept bytes as text, without the bytes of characters that were cut in two."""

    @F.arrow_udf("string")
    def read(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else readable(v) for v in values.to_pylist()], pa.string())

    return read(kept)
