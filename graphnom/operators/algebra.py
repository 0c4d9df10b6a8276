"""Matrix-free linear operators: an expression tree that compiles to joins and aggregates.

Vectors come and go as a table (id, col, x), zeros left out, and a matrix as a table (i, j, v). In between, vectors are
dense blocks and matrices tiles (`blocks`): a node of the tree makes parts of its product, so that sums are unions, and
parts are summed only where a product or the result needs the block. A matrix is tiled when it is first multiplied;
nothing else is computed before an action asks for the result.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphnom.plans.tables import materialise

from . import blocks as B
from . import graph, neighbours

T = TypeVar("T")
#: Cells up to which an operator is shown as a dense matrix.
SHOWN_CELLS = 10_000


def unit_vectors(ids: DataFrame) -> DataFrame:
    """ids: id. One column for each id."""
    return ids.select("id", F.col("id").alias("col"), F.lit(1.0).alias("x"))


class Operator:
    """A linear map between the indices 0 to shape-1. Made of a function from a block and its width to parts."""

    def __init__(self, shape: tuple[int, int], parts: Callable[[DataFrame, int], DataFrame], transposed: Callable[[], Operator] | None = None):
        self.shape, self.parts, self._transposed = shape, parts, transposed
        self.rows: neighbours.Rows | None = None  # of an operator that is an adjacency by rows and no more

    def product(self, x: DataFrame, width: int) -> DataFrame:
        """The block that a block is mapped to."""
        return B.summed(self.parts(x, width), width, self.shape[0])

    def apply(self, x: DataFrame, width: int | None = None) -> DataFrame:
        """The same for vectors (id, col, x). width: the number of columns; looked up in x if it is not given."""
        if width is None:
            width = 1 + (x.agg(F.max("col")).first()[0] or 0)
        return B.unpack(self.product(B.pack(x.select("id", "col", "x"), width), width), width)

    def transpose(self) -> Operator:
        if self._transposed is None:
            raise NotImplementedError("this operator has no transpose")
        return self._transposed()

    def __add__(self, other: Operator | float) -> Operator:
        if not isinstance(other, Operator):  # a number is added to every entry
            if self.shape[0] != self.shape[1]:
                raise ValueError("a number can be added to square operators only")
            return self + ones(self.shape[0], float(other))
        if self.shape != other.shape:
            raise ValueError(f"{self.shape} and {other.shape}")
        return Operator(self.shape, lambda x, w: self.parts(x, w).unionByName(other.parts(x, w)), lambda: self.transpose() + other.transpose())

    __radd__ = __add__

    def __neg__(self) -> Operator:
        return self * -1.0

    def __sub__(self, other: Operator | float) -> Operator:
        return self + (-other)

    def __mul__(self, other: Operator | float) -> Operator:
        if isinstance(other, Operator):
            if self.shape[1] != other.shape[0]:
                raise ValueError(f"{self.shape} and {other.shape}")
            return Operator((self.shape[0], other.shape[1]), lambda x, w: self.parts(other.product(x, w), w), lambda: other.transpose() * self.transpose())
        c = float(other)
        return Operator(self.shape, lambda x, w: scaled(self.parts(x, w), w, c), lambda: self.transpose() * c)

    __rmul__ = __mul__

    def get(self, spark, i: int, j: int) -> float:
        unit = spark.createDataFrame([(j, 0, 1.0)], "id long, col long, x double")
        row = self.apply(unit, 1).where(F.col("id") == i).first()
        return row.x if row else 0.0

    def todense(self, spark) -> np.ndarray:
        """For tests and small operators: every entry is collected."""
        out = np.zeros(self.shape)
        for r in self.apply(unit_vectors(spark.range(self.shape[1])), self.shape[1]).collect():
            out[r.id, r.col] = r.x
        return out

    def __repr__(self) -> str:
        """Name and shape; a small operator's entries too, if there is a session to find them with."""
        name, spark = f"{type(self).__name__}{self.shape}", SparkSession.getActiveSession()
        if spark is None or self.shape[0] * self.shape[1] > SHOWN_CELLS:
            return name
        return f"{name}\n{self.todense(spark)}"

    def scaled_by_sums(self, spark, rows: bool) -> Operator:
        """Divided by its row (else column) sums; a sum of 0 is left."""
        n = self.shape[1] if rows else self.shape[0]
        side = self if rows else self.transpose()
        sums = side.apply(spark.range(n).select("id", F.lit(0).cast("long").alias("col"), F.lit(1.0).alias("x")), 1)
        inverse = diagonal(side.shape[0], sums.where("x <> 0").select("id", (1 / F.col("x")).alias("d")))
        return inverse * self if rows else self * inverse

    def row_stochastic(self, spark) -> Operator:
        return self.scaled_by_sums(spark, True)

    def column_stochastic(self, spark) -> Operator:
        return self.scaled_by_sums(spark, False)


def scaled(parts: DataFrame, width: int, c: float) -> DataFrame:
    return B.transformed(parts, lambda x: c * x, {"x": width})


def once(make: Callable[[], T]) -> Callable[[], T]:
    """make, called when first asked for and kept."""
    held: list[T] = []

    def get() -> T:
        if not held:
            held.append(make())
        return held[0]

    return get


def vector(weights: DataFrame) -> Callable[[], DataFrame]:
    """weights (id, w) as a written block of one vector (b, u), made when first asked for."""
    return once(lambda: materialise(B.pack(weights.select("id", F.lit(0).alias("col"), F.col("w").alias("x")), 1).withColumnRenamed("x", "u")))


def sparse(shape: tuple[int, int], matrix: DataFrame, symmetric: bool = False) -> Operator:
    tiles = once(lambda: B.tiled(matrix))
    out = Operator(shape, lambda x, w: B.multiplied(tiles(), x, w, shape[1]))
    out._transposed = (lambda: out) if symmetric else lambda: sparse(shape[::-1], matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return out


def adjacency(edges: DataFrame) -> Operator:
    """The symmetric adjacency of edges (src, dst), which are counted neither before nor after they are dealt: one that
    is listed twice, either way round, weighs 2."""
    rows = neighbours.rows_of_edges(edges)
    out = symmetric(Operator((rows.n, rows.n), lambda x, w: neighbours.parts_of(rows, x, w)))
    out.rows = rows
    return out


def diagonal(n: int, d: DataFrame) -> Operator:
    """d: id, d."""
    own = vector(d.select("id", F.col("d").alias("w")))
    out = Operator((n, n), lambda x, w: B.transformed(x.join(own(), "b"), lambda x, u: u * x, {"x": w, "u": 1}))
    out._transposed = lambda: out
    return out


def constant_diagonal(n: int, c: float) -> Operator:
    out = Operator((n, n), lambda x, w: scaled(x, w, c))
    out._transposed = lambda: out
    return out


def weighted_sums(x: DataFrame, width: int, v: DataFrame | None) -> DataFrame:
    """One row (s): the sum of each column, weighted by a vector's block if one is given."""
    if v is None:
        return B.column_sums(x, lambda x: x.sum(axis=0, keepdims=True), {"x": width}, (1, width))
    return B.column_sums(x.join(v, "b"), lambda x, u: u.T @ x, {"x": width, "u": 1}, (1, width))


def rank_one(shape: tuple[int, int], u: DataFrame, v: DataFrame) -> Operator:
    """u v'. u, v: id, w."""
    left, right = vector(u), vector(v)
    return Operator(shape, lambda x, w: B.outer(left(), weighted_sums(x, w, right()), w), lambda: rank_one(shape[::-1], v, u))


def filled(n: int, c: float) -> Callable[[], DataFrame]:
    """The block of a vector whose every entry is c."""
    return once(lambda: vector(SparkSession.active().range(n).select("id", F.lit(float(c)).alias("w")))())


def ones(n: int, c: float = 1.0) -> Operator:
    """Every entry is c."""
    full = filled(n, c)
    out = Operator((n, n), lambda x, w: B.outer(full(), weighted_sums(x, w, None), w))
    out._transposed = lambda: out
    return out


def replicated_column(n: int, u: DataFrame) -> Operator:
    """u 1'."""
    own = vector(u)
    return Operator((n, n), lambda x, w: B.outer(own(), weighted_sums(x, w, None), w), lambda: replicated_row(n, u))


def replicated_row(n: int, u: DataFrame) -> Operator:
    """1 u'."""
    own, full = vector(u), filled(n, 1.0)
    return Operator((n, n), lambda x, w: B.outer(full(), weighted_sums(x, w, own()), w), lambda: replicated_column(n, u))


def pmi(n: int, matrix: DataFrame, constant: float, u: DataFrame) -> Operator:
    """F + constant 11' - u1' - 1u': sparse plus rank two. u: id, w for every id."""
    rest = u.select("id", (constant - F.col("w")).alias("w"))
    return symmetric(sparse((n, n), matrix, True) + replicated_column(n, rest) - replicated_row(n, u))


def symmetric(op: Operator) -> Operator:
    """An operator that is known to be its own transpose."""
    op._transposed = lambda: op
    return op


def laplacian(n: int, matrix: DataFrame) -> Operator:
    return sparse((n, n), graph.laplacian(matrix), True)


def normalized_laplacian(n: int, matrix: DataFrame) -> Operator:
    return constant_diagonal(n, 1.0) - sparse((n, n), graph.scaled(matrix), True)


def regularized_laplacian(n: int, matrix: DataFrame, tau: float | None = None) -> Operator:
    tau = graph.mean_degree(matrix, n) if tau is None else tau
    return constant_diagonal(n, 1.0) - sparse((n, n), graph.scaled(matrix, tau), True)


def diagonal_added(n: int, matrix: DataFrame) -> Operator:
    return sparse((n, n), graph.add_diagonal(matrix, n), True)


def blocks(grid: list[list[Operator]]) -> Operator:
    """A matrix of operators; the sizes along each row and column of the grid agree."""
    heights, widths = [row[0].shape[0] for row in grid], [b.shape[1] for b in grid[0]]
    if any(b.shape != (h, w) for row, h in zip(grid, heights, strict=True) for b, w in zip(row, widths, strict=True)):
        raise ValueError("block sizes do not agree")
    tops, lefts = np.concatenate([[0], np.cumsum(heights)]), np.concatenate([[0], np.cumsum(widths)])

    def parts(x: DataFrame, width: int) -> DataFrame:
        out = None
        for c in range(len(widths)):
            own = B.summed(B.shifted(x, -int(lefts[c]), widths[c], width), width, widths[c])
            for r, row in enumerate(grid):
                moved = B.shifted(row[c].parts(own, width), int(tops[r]), int(tops[-1]), width)
                out = moved if out is None else out.unionByName(moved)
        return out

    return Operator((int(tops[-1]), int(lefts[-1])), parts, lambda: blocks([[row[c].transpose() for row in grid] for c in range(len(widths))]))


def collapse_matrix(mapping: DataFrame) -> DataFrame:
    """i, j, v: column j (node) holds 1/k at each of its k images i. mapping: node, image."""
    share = 1.0 / F.count("*").over(Window.partitionBy("node"))
    return mapping.select(F.col("image").alias("i"), F.col("node").alias("j"), share.alias("v"))


def collapse(mapping: DataFrame, m: int, n: int) -> Operator:
    """mapping: node, image, distinct rows; every node has an image, and images are below m."""
    row = mapping.agg(F.count_distinct("node").alias("n"), F.max("image").alias("most"), F.min("image").alias("least")).first()
    if row.n != n or not 0 <= row.least <= row.most < m:
        raise ValueError("each node needs an image, and images are 0 to m - 1")
    return sparse((m, n), collapse_matrix(mapping))


def joint_blocks(diagonal_blocks: list[Operator], tau: float | None = None) -> Operator:
    """The given symmetric operators along the diagonal; elsewhere the mean of its row's and its column's, with tau
    added along that block's diagonal if given."""
    n = diagonal_blocks[0].shape[0]
    if any(b.shape != (n, n) for b in diagonal_blocks):
        raise ValueError("the blocks must be square and of one size")

    def between(a: Operator, b: Operator) -> Operator:
        mean = 0.5 * (a + b)
        return mean if tau is None else mean + constant_diagonal(n, tau)

    return blocks([[a if r == c else between(a, b) for c, b in enumerate(diagonal_blocks)] for r, a in enumerate(diagonal_blocks)])


def uncollapsed(collapse_op: Operator, similarity: Operator) -> Operator:
    """C' S C: node similarity as the mean similarity of both nodes' values, never built as a matrix."""
    return collapse_op.transpose() * similarity * collapse_op
