"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.join(least, "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); root is the least node of its component.

    Self-edges and repeated edges are harmless; edges with a null end are left
    out; no edges give no rows.  Each round is written to the shared folder, so
    lineage stays short; the number of rounds grows with the logarithm of the
    longest path.  A node's edges are reduced by min before they are shuffled;
    where they meet that minimum again, the join deals a node with very many
    edges to one task unless adaptive execution splits it, as it does by
    default; they are rows of two longs, and streamed.
    """
    start = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = Written(start.distinct())
    mark = None
    while True:
        found = now.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.xxhash64("b").cast("decimal(20,0)"))).first()
        if tuple(found) == mark or not found[0]:
            break
        mark = tuple(found)
        after = Written(_small_star(_large_star(now.df)))
        now.drop()
        now = after
    leaves = now.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionAll(leaves.select(F.col("root").alias("node"), "root").distinct())
