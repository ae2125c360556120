"""Connected components of a link table, as alternating star contractions; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quietgate.llm.common import ROWS_A_PART, cut


def _to_smallest_neighbour(edges: DataFrame, parts: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.coalesce(parts).distinct().coalesce(parts)


def _to_smallest_below(edges: DataFrame, parts: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).coalesce(parts).distinct().coalesce(parts)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    Links of a node with itself and null ends are ignored.  The number of rounds grows with the logarithm of the
    longest chain; the edges of each round are cut off from their lineage.
    """
    edges = cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        digest = edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if digest == before or not digest[0]:
            break
        before = digest
        parts = max(1, -(-digest[0] // ROWS_A_PART))  # few edges in many partitions would leave many files
        edges = cut(_to_smallest_below(_to_smallest_neighbour(edges.coalesce(parts), parts), parts))
    roots = edges.select("v").distinct().select(F.col("v").alias("u"), "v")
    return edges.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
