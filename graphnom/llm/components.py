"""Connected components of links between 64-bit nodes, by alternating stars.

Defined cases: repeated links and links of a node to itself count for nothing, so a node without another link has no row;
a component is named by its least node; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v. Large: each node hands its greater neighbours to its least one; small: the lesser ones.

    The least neighbour is a map-side combined aggregate; the join back splits where one node has a hot share of
    the edges, as both of its sides are plain tables.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = C.materialise(both.where("u <> v"))
    least = C.materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Each linked node with its component's least node: node, root."""
    edges = C.materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        edges = C.materialise(_star(C.materialise(_star(edges, True)), False))
        # stars only: every node points at its root, and roots point nowhere
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
