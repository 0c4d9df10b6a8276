"""Adjacency as triples (i, j, v), degrees and the matrix variants that are embedded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vertex_count(edges: DataFrame) -> int:
    """Vertices are 0 to the largest id that an edge names."""
    most = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return 0 if most is None else most + 1


def vertices(edges: DataFrame) -> DataFrame:
    return edges.sparkSession.range(vertex_count(edges)).withColumnRenamed("id", "node")


def symmetrize(triples: DataFrame) -> DataFrame:
    """M + transpose(M) - diagonal(M), entries at one place summed."""
    # counted as (least, greatest) first: half the rows go through the shuffle
    half = triples.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.sum("v").alias("v"))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return half.select(F.explode(both).alias("e"), "v").select("e.i", "e.j", "v")


def adjacency(edges: DataFrame) -> DataFrame:
    """The symmetric adjacency matrix; an edge that is listed twice, either way round, weighs 2."""
    return symmetrize(edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("v")))


def degrees(matrix: DataFrame) -> DataFrame:
    """Row sums: i, d. A self-loop counts once."""
    return matrix.groupBy("i").agg(F.sum("v").alias("d"))


def mean_degree(matrix: DataFrame, n: int) -> float:
    """Over all n vertices, isolated ones too."""
    return (matrix.agg(F.sum("v")).first()[0] or 0.0) / n if n else 0.0


def diagonal(spark_range: DataFrame, value) -> DataFrame:
    """A diagonal over (node): i, j, v."""
    return spark_range.select(F.col("node").alias("i"), F.col("node").alias("j"), value.cast("double").alias("v"))


def add_diagonal(matrix: DataFrame, n: int) -> DataFrame:
    """A + D/n."""
    own = degrees(matrix).select("i", F.col("i").alias("j"), (F.col("d") / n).alias("v"))
    return matrix.unionByName(own).groupBy("i", "j").agg(F.sum("v").alias("v"))


def scaled(matrix: DataFrame, shift: float = 0.0) -> DataFrame:
    """(D + shift)^-1/2 A (D + shift)^-1/2; the inverse root of 0 is 0."""
    d = degrees(matrix).select("i", (F.col("d") + shift).alias("d")).where("d > 0")
    rows = matrix.join(d.withColumnRenamed("d", "di"), "i")
    both = rows.join(d.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")
    return both.select("i", "j", (F.col("v") / F.sqrt(F.col("di") * F.col("dj"))).alias("v"))


def minus_from_identity(matrix: DataFrame, nodes: DataFrame) -> DataFrame:
    """I - M, zero entries left out."""
    own = diagonal(nodes, F.lit(1.0)).unionByName(matrix.select("i", "j", (-F.col("v")).alias("v")))
    return own.groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0")


def laplacian(matrix: DataFrame) -> DataFrame:
    """D - A."""
    own = degrees(matrix).select("i", F.col("i").alias("j"), F.col("d").alias("v"))
    return own.unionByName(matrix.select("i", "j", (-F.col("v")).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0")


def normalized_laplacian(matrix: DataFrame, nodes: DataFrame) -> DataFrame:
    """I - D^-1/2 A D^-1/2."""
    return minus_from_identity(scaled(matrix), nodes)


def regularized_laplacian(matrix: DataFrame, nodes: DataFrame, tau: float) -> DataFrame:
    """I - (D + tau)^-1/2 A (D + tau)^-1/2; tau: usually the mean degree."""
    return minus_from_identity(scaled(matrix, tau), nodes)


def stochastic(matrix: DataFrame, by: str) -> DataFrame:
    """Entries divided by their row's ("i") or column's ("j") sum; a sum of 0 leaves zeros."""
    sums = matrix.groupBy(by).agg(F.sum("v").alias("s"))
    return matrix.join(sums, by).select("i", "j", F.when(F.col("s") == 0, 0.0).otherwise(F.col("v") / F.when(F.col("s") != 0, F.col("s"))).alias("v"))
