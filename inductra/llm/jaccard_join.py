"""Exact Jaccard join of word shingles, by vertical partitioning.

The global order of shingles puts those that few classes hold first, by hash, then the
frequent ones by how frequent they are. It is cut into fragments: ``FRAGMENTS`` ranges of hashes
and the frequent ones. A set lies in as many rows as it has fragments, each row with the part of
the set in one; fragments are partitioned apart from each other, the overlap of a candidate pair
is counted in every fragment where both have a part, and the partial counts are summed per pair.
No row and no task sees a whole set.

Equal sets are one class. Only documents most of whose shingles occur elsewhere can have a link;
they are found first, by bits that shards of the hash space send back to chunks of documents.
Candidates share one of the first shingles that a link cannot do without; how many of these they
share is counted, and bounds the rest; so do sketches of the sets, of a fixed size.

Components are wanted, not all pairs. So candidates go from few to all: in quick rounds each
class is compared with the neighbour, in the order by size, that it shares most first shingles
with, then with neighbours in shuffled orders; then every remaining pair is. Each round leaves out pairs that are already connected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import blake2b
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inductra.llm.chunks import (
    NO_ID,
    Chunk,
    chunk_table,
    each_answered,
    is_in,
    shard_bits,
    shared_flags,
    shared_hashes,
)
from inductra.llm.common import GOLDEN, forget, list_array, lower_ascii, mix, store, word_hashes, words
from inductra.llm.components import components, joined_roots
from inductra.operators.ordered import previous_value

#: Words of a shingle.
SHINGLE = 5
#: A link needs 100 * shared >= THRESHOLD * united shingles.
THRESHOLD = 75

#: Ranges of the hashes of infrequent shingles, a power of two, and the hashes that part them.
FRAGMENTS = 4
CUTS = np.arange(1 - FRAGMENTS // 2, FRAGMENTS // 2, dtype=np.int64) << np.int64(65 - FRAGMENTS.bit_length())

#: Classes that hold a shingle from which on it may count as frequent, and the most shingles
#: that do; they are broadcast. The choice only orders shingles, it drops none.
FREQUENT = 32
MOST_FREQUENT = 1 << 18

#: Bits of a set's sketch: whether the number of its shingles that fall on a bit is odd. Two sets
#: differ in as many shingles at least as their sketches differ in bits. Where pairs meet, the
#: sketch is folded to ``FOLDED`` bits.
SKETCH = 2048
FOLDED = 256

#: Shingles before a shared one by which a pair tells that it has met already.
LOOK_BACK = 8

#: Rounds in which each class is compared with its best neighbour in the order by size only.
#: After them come rounds of neighbours in shuffled orders, as long as one class in
#: ``WORTHWHILE`` of those that still share a first shingle with another component gets a link.
#: Rounds only save work: what they leave is compared in full.
ORDERED_ROUNDS = 2
WORTHWHILE = 50


def shingles(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, text after text: (hashes, sizes, class).

    A text with fewer words than a shingle has one, of all its words. The class is a number
    from a 128-bit digest of the set, as two 64-bit halves in a two-column array.
    """
    _, ids, raw, offsets = chunk
    start, end, of = words(raw, offsets)
    h = word_hashes(lower_ascii(raw), start, end)
    counts = np.bincount(of, minlength=len(ids)).astype(np.int64)
    n = len(h)
    grams = np.full(max(0, n - SHINGLE + 1), SHINGLE, np.uint64)
    for i in range(SHINGLE):
        grams = mix(grams * GOLDEN + h[i : i + len(grams)])
    begins = np.cumsum(counts) - counts
    out, sizes, classes = [], np.zeros(len(ids), np.int64), np.zeros((len(ids), 2), np.int64)
    for i, (at, count) in enumerate(zip(begins.tolist(), counts.tolist())):
        if count == 0:
            continue
        if count < SHINGLE:
            whole = np.full(1, count, np.uint64)
            for j in range(count):
                whole = mix(whole * GOLDEN + h[at + j : at + j + 1])
            found = whole
        else:
            found = np.unique(grams[at : at + count - SHINGLE + 1])
        out.append(found)
        sizes[i] = len(found)
        classes[i] = np.frombuffer(blake2b(found.tobytes(), digest_size=16).digest(), np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes, classes


def owned_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    hashes, sizes, classes = shingles(chunk)
    return hashes, np.repeat(classes[:, 0], sizes)


ROWS = "row_id bigint, chunk bigint, n_shingles bigint, class string, shared array<bigint>"


def sets_of(df: DataFrame, text: str, row_id: str) -> DataFrame:
    """Stored rows (row_id, chunk, n_shingles, class, shared).

    ``shared`` holds, by hash, the shingles that may occur in another class; it is null where they are too few for any link, and on all but the first row of a class in its
    chunk. ``class`` is null for texts without words.
    """
    chunks = chunk_table(df, text, row_id)
    bits = shard_bits(chunks)
    flags = shared_flags(chunks, bits, owned_hashes)

    def keep(chunk: Chunk, answers: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        number, ids, _, _ = chunk
        hashes, sizes, classes = shingles(chunk)
        shared = is_in(hashes, shared_hashes(hashes, bits, answers))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        total = np.concatenate([[0], np.cumsum(shared)])
        counts = total[ends] - total[starts]
        enough = (100 * counts >= THRESHOLD * sizes) & (sizes > 0)
        _, firsts = np.unique(classes, axis=0, return_index=True)
        first = np.zeros(len(ids), bool)
        first[firsts] = True
        enough &= first
        ordered = hashes.view(np.int64)
        runs = [np.sort(ordered[a:b][shared[a:b]]) for a, b in zip(starts[enough].tolist(), ends[enough].tolist())]
        lists = list_array(
            pa.array(np.concatenate(runs) if runs else np.zeros(0, np.int64), pa.int64()), counts * enough
        )
        lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(~enough))
        names = [row.tobytes().hex() if n else None for row, n in zip(classes, sizes.tolist())]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64(), mask=ids == NO_ID),
                pa.array([number] * len(ids), pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(names, pa.string()),
                lists,
            ],
            ["row_id", "chunk", "n_shingles", "class", "shared"],
        )

    rows = store(each_answered(chunks, flags, keep, ROWS), "shingle-sets")
    forget(chunks)
    return rows


def links_among(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough, by overlaps counted per fragment and summed.

    ``parts`` has a row (node, n, fragment, tokens) per fragment of a node.
    """
    of_a = parts.select(F.col("node").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("tokens").alias("tokens_a"))
    of_b = parts.select(F.col("node").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("tokens").alias("tokens_b"))
    met = pairs.select("a", "b").join(of_a, "a").join(of_b, ["b", "fragment"])
    partial = met.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("both"))
    counted = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("both").alias("both"))
    return counted.where(100 * F.col("both") >= THRESHOLD * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def frequent_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and the binary logarithm of how many classes hold each.

    The bound rises by powers of two until no more than ``MOST_FREQUENT`` are left.
    """
    counts = sets.select(F.explode("shared").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    level = F.floor(F.log2("n")).cast("int")
    counts = store(counts.where(F.col("n") >= FREQUENT).select("token", level.alias("level")), "frequent-shingles")
    sizes = sorted((r["level"], r["count"]) for r in counts.groupBy("level").count().collect())
    while sum(n for _, n in sizes) > MOST_FREQUENT:
        sizes.pop(0)
    if not sizes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counts.where(F.col("level") >= sizes[0][0]).collect()
    tokens, levels = np.array([r["token"] for r in rows], np.int64), np.array([r["level"] for r in rows], np.int64)
    order = np.argsort(tokens)
    return tokens[order], levels[order]


PARTS = "node bigint, n bigint, m bigint, fragment int, tokens array<bigint>, first int, sketch array<bigint>"


def sketch(run: np.ndarray) -> np.ndarray:
    """The parities of a set's shingles by their lowest bits, in 64-bit numbers."""
    odd = np.bincount(run & np.int64(SKETCH - 1), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def in_fragments(sets: DataFrame) -> DataFrame:
    """Stored rows (node, n, m, fragment, tokens, first, sketch): each set cut by the global order.

    A link of a node with n shingles shares at least THRESHOLD % of n; so it shares one of the
    first m - that + 1 of its m shared ones. ``first`` of the part's tokens are among these.
    One row of a node has its sketch.
    """
    frequent = sets.sparkSession.sparkContext.broadcast(frequent_shingles(sets))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, levels = frequent.value
        for batch in batches:
            rows = []
            for node, n, found in zip(*(batch.column(c) for c in ("node", "n", "shared"))):
                run = found.values.to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(tokens, run), max(len(tokens) - 1, 0))
                often = tokens[at] == run if len(tokens) else np.zeros(len(run), bool)
                level = levels[at] * often if len(tokens) else np.zeros(len(run), np.int64)
                ranked = np.lexsort((run, level))
                run = run[ranked]
                rare = int((~often).sum())
                edges = np.concatenate([[0], np.searchsorted(run[:rare], CUTS), [rare, len(run)]]).tolist()
                upto = len(run) + 1 - -(-THRESHOLD * n.as_py() // 100)
                bits = sketch(run)
                for fragment, (a, b) in enumerate(zip(edges, edges[1:])):
                    if a < b:
                        first = min(max(upto - a, 0), b - a)
                        rows.append((node.as_py(), n.as_py(), len(run), fragment, run[a:b], first, bits))
                        bits = None
            columns = list(zip(*rows)) or [()] * 7
            flat = pa.array(np.concatenate(columns[4]) if rows else np.zeros(0, np.int64), pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), None, pa.int32(), pa.list_(pa.int64()))
            arrays = [pa.array(c, k) if k else None for c, k in zip(columns, kinds)]
            arrays[4] = list_array(flat, np.array(list(map(len, columns[4])), np.int64))
            yield pa.RecordBatch.from_arrays(arrays, ["node", "n", "m", "fragment", "tokens", "first", "sketch"])

    return store(sets.select("node", "n", "shared").mapInArrow(cut, PARTS), "shingle-fragments")


def first_tokens(parts: DataFrame) -> DataFrame:
    """Stored rows (token, node, n, at): each first shingle of a node, with its place in the set."""
    earlier = F.sum(F.size("tokens")).over(Window.partitionBy("node").orderBy("fragment")) - F.size("tokens")
    some = parts.where("first > 0").withColumn("before", earlier)
    exploded = some.select("node", "n", "before", F.posexplode(F.slice("tokens", F.lit(1), F.col("first"))).alias("i", "token"))
    return store(exploded.select("token", "node", "n", (F.col("before") + F.col("i")).alias("at")), "first-shingles")


def _long_enough(smaller: str, larger: str):
    return 100 * F.col(smaller) >= THRESHOLD * F.col(larger)


def _may_link(shared: Column) -> Column:
    """Whether nodes a and b would link if ``shared`` of their shingles were the same."""
    return (100 + THRESHOLD) * shared >= THRESHOLD * (F.col("n_a") + F.col("n_b"))


def folded(column: str) -> Column:
    """A sketch of ``FOLDED`` bits from one of ``SKETCH``."""
    size = FOLDED // 64
    return F.array(*[reduce(Column.bitwiseXOR, [F.col(column)[i] for i in range(w, SKETCH // 64, size)]) for w in range(size)])


def most_by_sketch(bits: int = SKETCH) -> Column:
    """The most shingles that nodes a and b can share, by how their sketches of ``bits`` bits differ."""
    words = [F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(bits // 64)]
    return F.floor((F.col("m_a") + F.col("m_b") - reduce(add, words)) / 2)


def node_of(column: str = "class"):
    """A class as a number."""
    return F.xxhash64(column)


def node_roots(rows: DataFrame) -> DataFrame:
    """(node, root) of the classes with a link to another class; removes ``rows``, which are stored.

    What is stored on the way is removed at the end.
    """
    some = rows.where("shared IS NOT NULL").select(
        node_of().alias("node"), "chunk", F.col("n_shingles").alias("n"), "shared"
    )
    # A class has its shingles once per chunk at most.
    least = some.groupBy("node").agg(F.min("chunk").alias("chunk"))
    sets = store(some.join(least, ["node", "chunk"]).drop("chunk"), "shingle-classes")
    forget(rows)
    parts = in_fragments(sets)
    forget(sets)
    tokens = first_tokens(parts)
    chain = store(_neighbours(tokens, [F.col("n"), F.col("node")]), "neighbours")
    tried, roots, number, read = None, None, 0, [tokens, parts, chain]
    while True:
        if number < ORDERED_ROUNDS:
            some = chain if roots is None else _apart(chain, roots)
        else:
            mixed, n_open = _mixed(tokens, roots)
            some = _neighbours(mixed, [F.xxhash64("node", F.lit(number)), F.col("node")])
        some = some if tried is None else some.join(tried, ["a", "b"], "left_anti")
        best = some.groupBy("b").agg(F.max(F.struct("votes", "a")).alias("best")).select("best.a", "b")
        best = store(best, "candidates")
        read.append(best)
        found = store(links_among(best, parts), "links")
        tried = best if tried is None else tried.union(best)
        last, roots = roots, store(components(found) if roots is None else joined_roots(roots, found), "roots")
        number += 1
        done = number > ORDERED_ROUNDS and found.count() * WORTHWHILE <= n_open
        forget(found, *([] if last is None else [last]), *([mixed] if number > ORDERED_ROUNDS else []))
        if done:
            break

    pairs, made = _open_pairs(tokens, parts, roots)
    rest = store(pairs.join(tried, ["a", "b"], "left_anti"), "candidates")
    forget(*made)
    found = store(links_among(rest, parts), "links")
    final = store(joined_roots(roots, found), "roots")
    forget(*read, rest, found, roots)
    return final


def _neighbours(tokens: DataFrame, order: list[Column]) -> DataFrame:
    """(a, b, votes): nodes that follow each other in the lists of ``votes`` shingles; a is not larger."""
    ranked = tokens.select("token", "node", "n", *([] if "root" not in tokens.columns else ["root"]))
    ranked = ranked.withColumns({f"rank_{i}": c for i, c in enumerate(order)})
    names = [c for c in ranked.columns if c in ("node", "n", "root")]
    met = previous_value(ranked, ["token"], [f"rank_{i}" for i in range(len(order))], names, "before")
    met = met.where("before IS NOT NULL")
    if "root" in names:
        met = met.where("before.root <> root")
    one, two = F.struct("n", "node"), F.struct("before.n", "before.node")
    small, large = F.least(one, two), F.greatest(one, two)
    pairs = met.select(small.alias("s"), large.alias("l")).where(100 * F.col("s.n") >= THRESHOLD * F.col("l.n"))
    return pairs.groupBy(F.col("s.node").alias("a"), F.col("l.node").alias("b")).agg(F.count(F.lit(1)).alias("votes"))


def _mixed(tokens: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """``tokens`` with their node's root, of shingles that several components have; and how many nodes."""
    placed = tokens.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = placed.join(several.where("low <> high").select("token"), "token", "left_semi")
    mixed = store(mixed, "open-shingles")
    return mixed, mixed.agg(F.countDistinct("node")).first()[0]


def _open_pairs(tokens: DataFrame, parts: DataFrame, roots: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """All pairs (a, b) of nodes not connected yet that may link, each once; and the tables stored for them."""
    nodes = parts.groupBy("node").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.first("sketch", True).alias("sketch"))
    nodes = store(nodes, "fragment-nodes")
    mixed, _ = _mixed(tokens, roots)
    met = _meetings(mixed, nodes).distinct()
    of_a = nodes.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("n", "m", "sketch")])
    of_b = nodes.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("n", "m", "sketch")])
    pairs = met.join(of_a, "a").join(of_b, "b").where(_may_link(most_by_sketch(SKETCH))).select("a", "b")
    return pairs, [nodes, mixed]


def _meetings(mixed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes that meet at a first shingle and may link; each about once.

    A link meets at the first shingle, in the global order, that both have. From there on it can
    share no more than the shorter rest of the two, and its sketches bound the overlap too. A
    pair that misses a bound is left out where it meets, before anything is shuffled. So is one
    that shares one of the few shingles before: it has met there. The first meeting has none, so
    each link is found; by chance a pair may meet again.
    """
    placed = mixed.join(nodes.select("node", "m", folded("sketch").alias("sketch")), "node")
    earlier = Window.partitionBy("node").orderBy("at").rowsBetween(-LOOK_BACK, -1)
    placed = placed.withColumn("before", F.collect_list("token").over(earlier))
    columns = ("node", "n", "m", "at", "root", "sketch", "before")
    one = placed.select("token", *[F.col(c).alias(f"{c}_a") for c in columns])
    two = placed.select(F.col("token").alias("token_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    apart = F.col("root_a") != F.col("root_b")
    same = F.col("token") == F.col("token_b")
    most = F.least(F.col("m_a") - F.col("at_a"), F.col("m_b") - F.col("at_b"))
    bounds = _may_link(most) & _may_link(most_by_sketch(FOLDED)) & ~F.arrays_overlap("before_a", "before_b")
    met = one.join(two, same & order & apart & _long_enough("n_a", "n_b") & bounds)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are not connected yet."""
    of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    joined = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    return joined.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")


def near_duplicates(df: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(row id, n_shingles, component_id) for every row.

    Shingles are ``SHINGLE`` words, A-Z lower-cased, counted once; two rows link when
    100 * shared >= ``THRESHOLD`` * united. The component is named by its smallest row id. Rows
    without words (missing, empty or blank texts) link with nothing. Rows of equal text always
    link; a row that is there twice is returned twice. A missing id is never the smallest
    unless all of its component are missing. Shingles are compared by 64-bit hashes; equal sets
    are told by 128-bit digests, and in links by 64 bits of these. An empty table gives no rows.
    """
    rows = sets_of(df, text, row_id)
    known = store(rows.select("row_id", "n_shingles", "class"), "row-classes")
    roots = node_roots(rows)
    least = known.where("class IS NOT NULL").groupBy("class").agg(F.min("row_id").alias("least"))
    placed = least.withColumn("node", node_of()).join(roots, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "root").select("class", "component_id")
    joined = known.join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("row_id")).otherwise(F.col("component_id"))
    return joined.select(F.col("row_id").alias(row_id), "n_shingles", component.alias("component_id"))
