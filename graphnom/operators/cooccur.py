"""Counts of value pairs across edges, and the similarity matrices made of them.

A node without a value of the type stands as a value of its own (a token). Pairs are counted once for each edge
and each two values of its ends, unordered; the counts are summed by (least, greatest) before anything else.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphnom.functions import measures as M
from graphnom.functions.text import token
from graphnom.plans.tables import materialise

from .graph import symmetrize


def vocabulary(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """val, idx: values and the tokens of nodes without any, in binary order from 0. values: node, val."""
    lacking = nodes.join(values.select("node").distinct(), "node", "left_anti").select(token(F.col("node")).alias("val"))
    there = values.join(nodes, "node", "left_semi").select("val").distinct().union(lacking)
    return numbered(there, "val", "idx")


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows with their place (from 0) in the order of a column of distinct values. They are dealt into ranges that are
    each numbered alone, from how many rows the ranges before hold."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(rows.repartitionByRange(n, by).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1 + F.col("_first")
    return dealt.join(F.broadcast(firsts), "_range").withColumn(name, place.cast("long")).drop("_range", "_first")  # one row for each range


@dataclass
class PairCounts:
    """pairs: a, b, c with a <= b; marginals: val, m; totals and the vocabulary's size."""

    pairs: DataFrame
    marginals: DataFrame
    total: float
    values: int


#: Edges of a vertex above which it is a hub, and how many hubs are split at most: those with the most edges.
HUB, HUBS = 1 << 20, 100_000


def hubs(edges: DataFrame) -> DataFrame:
    """side, node, parts: the vertices that are the src or dst of more than HUB rows, and how many parts of about that
    many they are dealt into. At most HUBS rows."""
    ends = edges.select(F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("node")), F.struct(F.lit("dst").alias("side"), F.col("dst").alias("node")))).alias("e"))
    counted = ends.groupBy("e.side", "e.node").agg(F.count("*").alias("n")).where(F.col("n") > HUB)
    return counted.orderBy(F.desc("n"), "side", "node").limit(HUBS).select("side", "node", F.ceil(F.col("n") / HUB).cast("int").alias("parts"))


def with_values(edges: DataFrame, values: DataFrame, side: str, name: str, split: DataFrame) -> DataFrame:
    """edges with the values of one side's vertex, null where it has none. The edges of a hub are dealt into parts by
    their other end, and the hub's values are sent to each part; all others join as they are."""
    other = "dst" if side == "src" else "src"
    own = F.broadcast(split.where(F.col("side") == side).select(F.col("node").alias("_hub"), "parts"))  # at most HUBS rows
    parts = F.coalesce("parts", F.lit(1))
    dealt = edges.join(own, F.col(side) == F.col("_hub"), "left").withColumn("_part", F.pmod(F.xxhash64(other), parts).cast("int")).drop("_hub", "parts")
    sent = values.join(own, F.col("node") == F.col("_hub"), "left").select(F.col("node").alias(side), F.col("val").alias(name), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    return dealt.join(sent, [side, "_part"], "left").drop("_part")


def pair_counts(edges: DataFrame, values: DataFrame) -> DataFrame:
    """a, b, c: how many edges join the two values. values: node, val, distinct rows."""
    # edges that repeat are counted before they meet their values
    e = materialise(edges.groupBy("src", "dst").agg(F.count("*").alias("w")))
    split = materialise(hubs(e))
    joined = with_values(with_values(e, values, "src", "x", split), values, "dst", "y", split)
    u, v = F.coalesce("x", token(F.col("src"))), F.coalesce("y", token(F.col("dst")))
    return joined.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("c"))


def marginals(pairs: DataFrame) -> DataFrame:
    """val, m: the row sums of the symmetric count matrix; a pair of a value with itself counts once."""
    ends = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    return pairs.select(F.explode(ends).alias("val"), "c").groupBy("val").agg(F.sum("c").alias("m"))


def count_pairs(edges: DataFrame, values: DataFrame, nodes: DataFrame) -> PairCounts:
    pairs = materialise(pair_counts(edges, values))  # total, marginals and measures all read it
    size = values.join(nodes, "node", "left_semi").select("val").distinct().count() + nodes.join(values.select("node").distinct(), "node", "left_anti").count()
    return PairCounts(pairs, marginals(pairs), float(pairs.agg(F.sum("c")).first()[0] or 0), size)


def with_probabilities(counts: PairCounts, delta: float = 0.0) -> DataFrame:
    """pairs with pa, pb, pab."""
    total, size = F.lit(counts.total), F.lit(float(counts.values))
    one = counts.marginals.select("val", M.prob_one(F.col("m"), total, size, delta).alias("p"))
    out = counts.pairs.join(one.select(F.col("val").alias("a"), F.col("p").alias("pa")), "a")
    out = out.join(one.select(F.col("val").alias("b"), F.col("p").alias("pb")), "b")
    return out.select("a", "b", "c", "pa", "pb", M.prob_pair(F.col("c"), total, size, delta).alias("pab"))


def measured(counts: PairCounts, sim: str, delta: float = 0.0) -> DataFrame:
    """a, b, s for each observed pair, a <= b. A measure that is not symmetric is taken as of (a given b)."""
    if sim not in M.MEASURES:
        raise ValueError(f"no measure {sim!r}")
    return with_probabilities(counts, delta).select("a", "b", M.MEASURES[sim](F.col("pab"), F.col("pa"), F.col("pb")).alias("s"))


def similarity_matrix(counts: PairCounts, sim: str = "NPMI1s") -> DataFrame:
    """The symmetric value similarity over observed pairs: i, j (values), v."""
    return symmetrize(measured(counts, sim).select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("s").alias("v")))


def smoothed_pmi_parts(counts: PairCounts, delta: float) -> tuple[DataFrame, float, DataFrame]:
    """The smoothed similarity as sparse + constant - rank one terms: F, Delta, u with
    S = F + Delta 11' - u1' - 1u'. F holds ln(1 + c/delta) of observed pairs, u the logs of smoothed counts."""
    if delta <= 0:
        raise ValueError("smoothing needs delta > 0")
    sparse = symmetrize(counts.pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), F.log1p(F.col("c") / delta).alias("v")))
    p, v = counts.values * (counts.values + 1) / 2, counts.values
    constant = math.log(delta) + math.log(counts.total + delta * p)
    u = counts.marginals.select("val", F.ln(F.col("m") + delta * v).alias("u"))
    return sparse, constant, u
