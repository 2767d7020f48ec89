"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inductra.llm.common import forget, store


def _hang(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Hang neighbours of every node on the smallest of them; the sum per node is pre-aggregated."""
    least = pairs.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select(F.col("a").alias("of"), F.least("a", "least").alias("least"))
    joined = pairs.join(least, F.col("a") == F.col("of"))
    hung = joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
    if larger_only:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return hung.union(least.select(F.col("of").alias("a"), F.col("least").alias("b"))).where("a <> b")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of all nodes with a link to another; the root is the smallest node reachable.

    Every round is stored, and the rounds end when the links no longer change. Missing ends and
    links of a node to itself are left out.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    seen = None
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _hang(both, True).distinct()
        # Every pair now points from the larger to the smaller end.
        before, pairs = pairs, store(_hang(large, False).distinct(), "component-links")
        if seen is not None:
            forget(before)
        sums = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                pairs.select("b", "b").distinct()
            )
        seen = tuple(sums)


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) once ``links`` (a, b) are added to components known before.

    Only the components that the links touch are worked on, as single nodes.
    """
    of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    between = links.join(of_a, "a", "left").join(of_b, "b", "left")
    between = between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    moved = components(between).withColumnsRenamed({"node": "from", "root": "to"})
    kept = roots.join(moved, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root"))
    fresh = moved.join(roots, F.col("from") == F.col("node"), "left_anti")
    return kept.union(fresh.select("from", "to"))
