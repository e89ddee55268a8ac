"""Connected components of a graph given as edges, by alternating star operations.

Every round is two groupings and joins over the edges; labels shrink to the smallest node of a
component in a number of rounds that grows with the logarithm of the longest path. Nothing of the
graph comes to the driver but one count and one checksum a round. A node with very many
neighbours is one key of an aggregate with partial sums and of a join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitloom.session import materialise


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's neighbours (for small stars: only smaller ones) hung on the smallest of them."""
    both = edges.filter("u != v")
    if small:
        seen = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        seen = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    hung = seen.join(low, "u")
    if small:
        moved = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
    else:
        moved = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; *edges* are (u, v). Roots are smallest nodes."""
    now = materialise(edges.select("u", "v").filter("u != v").distinct(), "edges")
    mark = None
    while True:
        now = materialise(_stars(_stars(now, small=False), small=True), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return leaves.unionByName(roots)
