"""Numeric attributes, scaling, projection to the sphere, stacking and principal components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphnom.plans.shipping import ship_package
from graphnom.plans.tables import materialise


def numeric_pivot(rows: DataFrame, types: tuple[str, ...], nodes: DataFrame | None = None) -> DataFrame:
    """node and a double column for each type; what is no number is null, two values of one node and type raise.
    With nodes, each of them has a row."""
    own = rows.where(F.col("attributeType").isin(*types)).select("node", "attributeType", F.col("attributeVal").try_cast("double").alias("x"))
    once = own.groupBy("node", "attributeType").agg(F.count("*").alias("n"), F.max("x").alias("x"))
    twice = F.raise_error(F.concat(F.lit("two values of one node and type: "), F.col("node").cast("string"), F.lit(" "), F.col("attributeType"))).cast("double")
    once = once.select("node", "attributeType", F.when(F.col("n") > 1, twice).otherwise(F.col("x")).alias("x"))
    out = once.groupBy("node").pivot("attributeType", list(types)).agg(F.first("x"))
    return out if nodes is None else nodes.join(out, "node", "left")


#: Bins that a range is cut into when a middle value is sought.
BINS = 2048


def medians(df: DataFrame, columns: tuple[str, ...]) -> dict[str, float | None]:
    """The exact median of each column's known entries (NaN is none), None if there are none.

    Both middle ranks are sought in a range that shrinks: a pass counts the values of BINS bins and takes the least and
    the largest value of the bin that holds the rank. What reaches the driver does not depend on the values.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in columns]))
    rows = materialise(df.select(cells.alias("r")).select("r.c", "r.x").where("x is not null and not isnan(x)"))
    spans = {r.c: (r.n, r.lo, r.hi) for r in rows.groupBy("c").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    # column and rank (from 0): the least and largest value it may have, and how many values lie below
    open_ = {(c, rank): (lo, hi, 0) for c, (n, lo, hi) in spans.items() for rank in {(n - 1) // 2, n // 2}}
    while asked := [(c, rank, lo, hi) for (c, rank), (lo, hi, _) in open_.items() if lo < hi]:
        table = F.broadcast(df.sparkSession.createDataFrame(asked, "c string, rank long, lo double, hi double"))  # two rows a column
        share = (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        place = F.when(F.col("x") == F.col("hi"), BINS - 1).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        held = rows.join(table, "c").where("x >= lo and x <= hi").groupBy("c", "rank", place.alias("place"))
        bins: dict[tuple[str, int], list] = {}
        for r in held.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            bins.setdefault((r.c, r["rank"]), []).append((r.lo, r.hi, r.n))
        for key, found in bins.items():
            below = open_[key][2]
            for lo, hi, n in sorted(found):
                if key[1] < below + n:
                    open_[key] = (lo, hi, below)
                    break
                below += n
    middle = {c: [lo for (k, _), (lo, _, _) in open_.items() if k == c] for c in columns}
    return {c: sum(v) / len(v) if v else None for c, v in middle.items()}


def impute(df: DataFrame, columns: tuple[str, ...], strategy: str = "mean") -> DataFrame:
    """Missing entries by the mean or the exact median of the known ones."""
    if strategy not in ("mean", "median"):
        raise ValueError(f"no imputation {strategy!r}")
    known = medians(df, columns) if strategy == "median" else df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(known[c]).cast("double")) for c in columns})


def moments(df: DataFrame, width: int, column: str = "features") -> DataFrame:
    """pos, mean, sd (of the population) of each place of an array column."""
    return df.select(F.posexplode(column).alias("pos", "x")).where(F.col("pos") < width).groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def zscored(df: DataFrame, width: int, column: str = "features") -> DataFrame:
    """Each place less its mean, divided by its population deviation (a deviation of 0 counts as 1)."""
    stats = {r.pos: (r["mean"], r.sd or 1.0) for r in moments(df, width, column).collect()}
    mean, sd = (F.array(*[F.lit(float(stats[k][j])) for k in range(width)]) for j in (0, 1))
    return df.withColumn(column, F.transform(F.arrays_zip(F.col(column).alias("x"), mean.alias("m"), sd.alias("s")), lambda r: (r["x"] - r["m"]) / r["s"]))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def on_sphere(df: DataFrame, column: str = "features") -> DataFrame:
    """Rows of length 1; a zero row stays."""
    size = norm(F.col(column))
    return df.withColumn(column, F.when(size > 0, F.transform(column, lambda v: v / size)).otherwise(F.col(column)))


def stacked(nodes: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """node, features: the blocks' arrays one behind the other, joined by node."""
    out = nodes.select("node")
    for k, b in enumerate(blocks):
        out = out.join(b.select("node", F.col("features").alias(f"_{k}")), "node")
    return out.select("node", F.concat(*[F.col(f"_{k}") for k in range(len(blocks))]).alias("features"))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: number of rows, and with it the sums of the places and of their products."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
            own = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).reshape(-1)])
            total = own if total is None else total + own
    yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.tolist()], pa.list_(pa.float64()))], ["sums"])


def covariance(df: DataFrame, width: int, column: str = "features") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, population covariance and number of rows. Only sums of products leave a task."""
    ship_package(df.sparkSession)
    sums = df.select(column).mapInArrow(_products, "sums array<double>").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    flat = np.zeros(1 + width + width * width)
    for r in sums.collect():  # as many rows as the covariance has entries
        flat[r.at] = r.x
    n = int(flat[0])
    mean = flat[1 : 1 + width] / max(n, 1)
    return mean, flat[1 + width :].reshape(width, width) / max(n, 1) - np.outer(mean, mean), n


def pca(df: DataFrame, width: int, components: int, whiten: bool = False, column: str = "features") -> tuple[np.ndarray, DataFrame]:
    """Explained variances (sample, falling) and the centred projections, divided by their deviation if whitened."""
    mean, cov, n = covariance(df, width, column)
    values, vectors = np.linalg.eigh(cov * n / max(n - 1, 1))
    order = np.argsort(-values)[: min(components, width)]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    if whiten:
        vectors = vectors / np.where(values > 0, np.sqrt(values), 1)
    weights = F.array(*[F.array(*[F.lit(float(v)) for v in vectors[:, c]]) for c in range(len(order))])
    centred = F.zip_with(F.col(column), F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m)
    dot = lambda w: F.aggregate(F.zip_with(centred, w, lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v)
    return values, df.withColumn(column, F.transform(weights, dot))


def log_density_constant(width: int, bandwidth: float) -> float:
    """ln of a Gaussian kernel's constant in so many dimensions."""
    return -0.5 * width * math.log(2 * math.pi) - width * math.log(bandwidth)
