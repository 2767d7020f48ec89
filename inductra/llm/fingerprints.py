"""Document fingerprints from closed syncmers over the bytes of a text.

A k-mer is an anchor if the smallest hash among its inner s-mers stands first or last in it.
Whether it is one depends on its own bytes only, so anchors of an edited text can be put
together from those of its untouched parts. A fingerprint has all anchors by rising hash,
each with its first position; two fingerprints are matched by hash, and a match counts if its
shift agrees with that of a neighbour, so that blocks may have moved by different lengths.

Everything is built-in expressions. Long texts are worked on in windows of ``WINDOW`` bytes,
so that arrays of s-mer hashes stay short.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of an anchor and of its inner strings; an anchor has 2 ** LEVELS of these.
LEVELS = 4
S = 9
INNER = 1 << LEVELS
K = S + INNER - 1

#: Inner strings side by side whose minimum is taken first, a power of two.
GROUP = 4

#: Anchors a fingerprint keeps: all.
KEPT = None

#: Bytes by which the shift of a match may differ from that of the match before or behind it.
SLACK = 64

WINDOW = 8192

#: Bytes of text in one slice of the order of ids, and the most slices there can be.
SLICE_BYTES = 16 << 20
MAX_SLICES = 1 << 16

#: An anchor is one number: 32 bits of its hash, then 31 bits of its position.
PLACE = (1 << 31) - 1


def anchors(raw: str, offset: str = "0") -> Column:
    """All anchors of a binary column, in order of position.

    An inner string that is the smallest of the whole k-mer is so of its own group of ``GROUP``
    neighbours; one in four is, and only these are compared with the other groups. The minima of
    groups come from pairwise minima over 2, 4, ...; each level is as long as the one below, and
    the last places, where fewer are left, are cut off once, as every cut copies all of it.
    """
    starts = f"CASE WHEN length({raw}) < {K} THEN array() ELSE sequence(0, length({raw}) - {K}, {WINDOW}) END"
    piece = f"substring({raw}, o + 1, {WINDOW + K - 1})"
    hashes = f"transform(sequence(1, length(b) - {S - 1}), i -> xxhash64(substring(b, i, {S})))"
    packed = f"shiftleft(xxhash64(substring(b, i + 1, {K})) & 4294967295, 31) | (o + i + {offset})"
    minima = f"m{GROUP.bit_length() - 1}"
    last = f"{minima}[i + {INNER - GROUP}]"
    left = [f"v <= {minima}[i + {j}]" for j in range(GROUP, INNER, GROUP)]
    right = [f"{last} <= v", *[f"{last} <= {minima}[i + {j}]" for j in range(GROUP, INNER - GROUP, GROUP)]]
    edge = f"(v = m0[i] AND {' AND '.join(left)}) OR ({last} = m0[i + {INNER - 1}] AND {' AND '.join(right)})"
    places = f"slice({minima}, 1, size(m0) - {INNER - 1})"
    found = f"filter(transform({places}, (v, i) -> CASE WHEN {edge} THEN {packed} END), x -> x IS NOT NULL)"
    for level in range(GROUP.bit_length() - 1, 0, -1):
        below, step = f"m{level - 1}", 1 << (level - 1)
        pairs = f"zip_with({below}, slice({below}, {step + 1}, size({below})), (x, y) -> least(x, y))"
        found = f"flatten(transform(array({pairs}), m{level} -> {found}))"
    in_piece = f"flatten(transform(array({hashes}), m0 -> {found}))"
    return F.expr(f"flatten(transform({starts}, o -> flatten(transform(array({piece}), b -> {in_piece}))))")


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _first_of_each(ranked: Column) -> Column:
    """Of anchors in order, each hash once at its first position."""
    fresh = lambda x, i: (i == 0) | (F.shiftright(x, 31) != F.shiftright(F.get(ranked, i - 1), 31))
    return F.filter(ranked, fresh)


def ordered(found: Column) -> Column:
    """The anchors of a fingerprint."""
    return _bind(F.sort_array(found), _first_of_each)


def or_whole(found: Column, raw: Column) -> Column:
    """A text too short for an anchor is one itself; an empty text has none."""
    whole = F.array(F.shiftleft(F.xxhash64(raw).bitwiseAND(4294967295), 31))
    return F.when((F.size(found) == 0) & (F.length(raw) > 0), whole).otherwise(found)


def smallest_of(raw: str) -> Column:
    """The fingerprint of a binary column as an array."""
    return _bind(ordered(anchors(raw)), lambda a: or_whole(a, F.col(raw)))


def written(found: str) -> Column:
    """A fingerprint as text: hash in hex, colon, position, joined by commas."""
    anchor = f"concat(lower(lpad(hex(shiftright(x, 31)), 8, '0')), ':', x & {PLACE})"
    return F.expr(f"array_join(transform({found}, x -> {anchor}), ',')")


def likeness(a: str, b: str) -> Column:
    """Share of the anchors of both that match in hash and go on alike, from 0 to 1.

    Matches are in the order of the first text. One counts if its shift differs by at most
    ``SLACK`` from that of the match before or behind it; a single match counts. Both lists
    rise, so sorting them together is one merge. Two empty fingerprints are alike.
    """
    side = "(shiftright(x, 31) - 2147483648) * 4294967296 + (x & {0}) + {1}"
    both = f"""sort_array(concat(transform({a}, x -> {side.format(PLACE, 0)}),
                                 transform({b}, x -> {side.format(PLACE, PLACE + 1)})))"""
    pair = f"shiftleft(x & {PLACE}, 31) | (get(s, i + 1) & {PLACE})"
    again = "shiftright(x, 32) = shiftright(get(s, i + 1), 32)"
    found = f"sort_array(filter(transform(s, (x, i) -> CASE WHEN {again} THEN {pair} END), x -> x IS NOT NULL))"
    shifts = f"transform({found}, x -> shiftright(x, 31) - (x & {PLACE}))"
    near = " OR ".join(f"coalesce(abs(x - get(d, i {step})) <= {SLACK}, false)" for step in ("- 1", "+ 1"))
    union = f"CAST(size({a}) + size({b}) - size(d) AS DOUBLE)"
    return F.expr(
        f"""CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1.0D ELSE
        element_at(transform(array({both}), s -> element_at(transform(array({shifts}),
            d -> size(filter(d, (x, i) -> size(d) = 1 OR {near})) / {union}), 1)), 1) END"""
    )


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of every text as a string; a missing text is an empty one."""
    raw = df.withColumn("__raw", F.coalesce(F.col(text), F.lit("")).cast("binary"))
    found = raw.withColumn("__found", smallest_of("__raw"))
    return found.withColumn(out, written("__found")).drop("__raw", "__found")


def _slice_bounds(rows: DataFrame) -> tuple[list[int], int]:
    """Ids that start a slice after the first, falling, and the largest id."""
    sizes = rows.agg(F.sum("n_bytes").alias("bytes"), F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).first()
    if not sizes["n"]:
        return [], 0
    slices = min(MAX_SLICES, sizes["n"], 1 + sizes["bytes"] // SLICE_BYTES)
    if slices == 1:
        return [], sizes["top"]
    shares = [i / slices for i in range(1, slices)]
    found = rows.agg(F.percentile_approx("id", shares, max(10_000, 10 * slices)).alias("b")).first()["b"]
    return sorted({b for b in found if b < sizes["top"]}, reverse=True), sizes["top"]


def _slice_of(bounds: list[int]) -> Column:
    """How many bounds are at or above an id, by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    listed = f"from_json('{json.dumps(bounds)}', 'array<bigint>')"
    jump = f"shiftleft(1, {steps} - j)"
    return F.expr(
        f"""aggregate(sequence(1, {steps}), 0, (at, j) ->
            CASE WHEN at + {jump} <= {len(bounds)} AND {listed}[least(at + {jump}, {len(bounds)}) - 1] >= id
                 THEN at + {jump} ELSE at END)"""
    )


def with_next(df: DataFrame, columns: list[str], made: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Rows by falling ``id`` with ``columns`` of the next row, the first row following the last.

    ``made`` adds columns once the rows are in their slices, so that these are not shuffled.

    Needs columns id, tie and n_bytes. Ids are cut into slices at ids that start one; such a row
    is also sent to the slice before as a guest, so that no slice has to look into another.
    """
    bounds, top = _slice_bounds(df.select("id", "n_bytes"))
    home = df.withColumn("slice", _slice_of(bounds))
    guest_of = F.when(F.col("id") == top, F.lit(len(bounds))).when(
        (F.col("slice") > 0) & F.array_contains(F.from_json(F.lit(json.dumps(bounds)), "array<bigint>"), F.col("id")),
        F.col("slice") - 1,
    )
    here = F.struct(F.lit(0).alias("guest"), F.col("slice").alias("at"))
    there = F.struct(F.lit(1).alias("guest"), guest_of.alias("at"))
    stops = F.when(guest_of.isNull(), F.array(here)).otherwise(F.array(here, there))
    sent = home.withColumn("stop", F.explode(stops)).select("*", "stop.guest", "stop.at").drop("stop", "slice")
    order = Window.partitionBy("at").orderBy("guest", F.desc("id"), "tie")
    sent = made(sent.repartition("at"))
    following = sent.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return following.where("guest = 0").drop("guest", "at")


def compare_with_edits(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    The edited text has its last third of code points (rounded down) replaced by as many first
    ones of the next text by falling id, or all of a shorter one; the first follows the last.
    Returns (row id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next). Missing texts are empty; a missing id comes last; rows of equal id are ordered
    by text. A single row is its own next. An empty table gives no rows.
    """
    rows = df.select(
        F.col(row_id).alias("row_id"),
        F.coalesce(F.col(row_id).cast("bigint"), F.lit(-(1 << 63))).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = rows.withColumns(
        {
            "tie": F.sha2(F.col("text").cast("binary"), 256),
            "n_bytes": F.octet_length("text").cast("bigint"),
            "n_chars": F.char_length("text").cast("bigint"),
        }
    )
    rows = rows.withColumn("moved", F.floor(F.col("n_chars") / 3).cast("int"))

    def with_anchors(sent: DataFrame) -> DataFrame:
        sent = sent.withColumn("kept", F.octet_length(F.expr("left(text, CAST(n_chars AS INT) - moved)")))
        sent = sent.withColumn("raw", F.col("text").cast("binary"))
        sent = sent.withColumn("own", ordered(anchors("raw")))
        return sent.withColumns({"whole": F.size("own") == 0, "own": or_whole(F.col("own"), F.col("raw"))}).drop("raw")

    linked = with_next(rows, ["text", "own", "whole"], with_anchors)
    edited = linked.withColumn(
        "edited", F.expr("concat(left(text, CAST(n_chars AS INT) - moved), left(next_text, moved))").cast("binary")
    )
    edited = edited.withColumn("fresh_from", F.greatest(F.lit(0), F.col("kept") - (K - 1)))
    edited = edited.withColumn("fresh", F.expr(f"substring(edited, fresh_from + 1, kept + {K - 1} - fresh_from)"))
    # Anchors depend on their own bytes only: those before the cut are the text's, those behind it the
    # next text's, and only those that go across are looked for. First positions are first in a part too.
    before_cut = F.filter("own", lambda x: ~F.col("whole") & (x.bitwiseAND(PLACE) <= F.col("kept") - K))
    in_next = F.length("edited") - F.col("kept") - K
    behind_cut = F.filter("next_own", lambda x: ~F.col("next_whole") & (x.bitwiseAND(PLACE) <= in_next))
    behind_cut = F.transform(behind_cut, lambda x: x + F.col("kept"))
    other = ordered(F.concat(before_cut, anchors("fresh", "fresh_from"), behind_cut))
    edited = edited.withColumn("other", _bind(other, lambda a: or_whole(a, F.col("edited"))))
    return edited.select(
        F.col("row_id").alias(row_id),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written("own").alias("fingerprint"),
        written("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"),
        likeness("own", "next_own").alias("near_next"),
    )
