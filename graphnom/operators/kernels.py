"""Sums of Gaussian kernels between two tables of rows, by blocks of near rows.

A tree of splits, told from a bounded sample, deals the rows of both tables into leaves: rows that lie near each other
stand in one block of at most some LEAF rows, as a dense array. Of each block its middle, its radius and its counts are
known, and so, for a block of queries, the least and the largest sum that a block of training rows can add. With an
error of 0 all pairs of blocks meet; with a positive one, a query block leaves out the blocks that together add at most
that share of what the others add at least, so that each sum is low by no more than that share. Pairs of blocks that
meet are joined; no row passes the driver but those of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphnom.plans.tables import materialise

from . import blocks as B

#: Rows of a block, about; rows that the tree is told from, at most; distances that a task holds.
LEAF, SAMPLE, KERNEL_CELLS = 16_384, 20_000, 1 << 22


def space_tree(rows: DataFrame, leaves: int) -> list[tuple[int, float]]:
    """Splits (place, threshold) of a complete binary tree, node k's children being 2k + 1 and 2k + 2: at the median of
    the place that spreads most. Told from at most SAMPLE rows, dealt by a hash; it shapes blocks, not results."""
    depth = max(0, int(np.ceil(np.log2(max(leaves, 1)))))
    if depth == 0:
        return []
    some = rows.select("features").orderBy(F.xxhash64("features")).limit(SAMPLE).collect()
    x = np.array([r.features for r in some], float)
    nodes: list[tuple[int, float]] = []
    held = [x]
    for _ in range(depth):
        below = []
        for own in held:
            place = int((own.max(axis=0) - own.min(axis=0)).argmax()) if len(own) else 0
            cut = float(np.median(own[:, place])) if len(own) else 0.0
            nodes.append((place, cut))
            below += [own[own[:, place] <= cut], own[own[:, place] > cut]]
        held = below
    return nodes


def dealt(rows: DataFrame, tree: list[tuple[int, float]]) -> DataFrame:
    """rows (node, key, features) as blocks: block, node, key (arrays), x (their features), n, others (n less the rows of
    the commonest key), middle, radius. A leaf of many rows is cut into several blocks."""
    places, cuts = (np.array([t[k] for t in tree]) for k in (0, 1))

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch["features"].flatten(), float).reshape(batch.num_rows, -1)
            at, known = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(tree) and (at < len(places)).any():
                go = at < len(places)
                at[go] = 2 * at[go] + 1 + (x[known[go], places[at[go]]] > cuts[at[go]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "leaf"])

    own = materialise(B.mapped(rows.select("node", "key", "features"), leaf, "node long, key long, features array<double>, leaf long"))
    parts = own.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("parts"))
    cut = own.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("node", "features"), F.col("parts")))
    lists = cut.groupBy("leaf", "part").agg(*[F.collect_list(F.coalesce(c, none)).alias(c) for c, none in (("node", F.lit(0)), ("key", F.lit(NO_KEY)), ("features", F.array().cast("array<double>")))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.string()), ("node", pa.binary()), ("key", pa.binary()), ("x", pa.binary()), ("n", pa.int64()), ("others", pa.int64()), ("middle", pa.list_(pa.float64())), ("radius", pa.float64())])

        def every():
            for batch in batches:
                for k in range(batch.num_rows):
                    node, key = (batch[c][k].values.to_numpy() for c in ("node", "key"))
                    x = batch["features"][k].values.flatten().to_numpy().reshape(len(node), -1)
                    middle = x.mean(axis=0)
                    common = np.unique(key[key != NO_KEY], return_counts=True)[1].max(initial=0)
                    radius = np.sqrt(((x - middle) ** 2).sum(axis=1).max())
                    yield f"{batch['leaf'][k]}-{batch['part'][k]}", node.tobytes(), key.tobytes(), x.tobytes(), len(node), len(node) - int(common), middle.tolist(), float(radius)

        return B.batched(every(), schema)

    return materialise(B.mapped(lists, pack, "block string, node binary, key binary, x binary, n long, others long, middle array<double>, radius double"))


#: The key of rows that have none.
NO_KEY = -(1 << 63)


def meetings(queries: DataFrame, train: DataFrame, bandwidths: list[float], error: float) -> DataFrame:
    """qb, tb: the pairs of blocks whose kernels are summed."""
    left = queries.select(F.col("block").alias("qb"), F.col("middle").alias("qm"), F.col("radius").alias("qr"))
    right = train.select(F.col("block").alias("tb"), F.col("middle").alias("tm"), F.col("radius").alias("tr"), "n", "others")
    pairs = left.crossJoin(right)  # of blocks, not of rows
    if error <= 0:
        return pairs.select("qb", "tb")
    apart = F.sqrt(F.aggregate(F.zip_with("qm", "tm", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    near = F.greatest(apart - F.col("qr") - F.col("tr"), F.lit(0.0))
    far = apart + F.col("qr") + F.col("tr")
    pairs = pairs.select("qb", "tb", "n", "others", near.alias("near"), far.alias("far"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names = np.array(batch["tb"][k].as_py())
                n, others, near, far = (batch[c][k].values.to_numpy() for c in ("n", "others", "near", "far"))
                needed = np.zeros(len(names), bool)
                for h in bandwidths:
                    with np.errstate(divide="ignore"):
                        most, least = np.log(n) - near**2 / (2 * h * h), np.log(others) - far**2 / (2 * h * h)
                    top = least.max()
                    if not np.isfinite(top):
                        needed[:] = True
                        continue
                    whole = top + np.log(np.exp(least - top).sum())
                    order = np.argsort(most, kind="stable")
                    left_out = np.cumsum(np.exp(np.minimum(most[order] - whole, 700.0))) <= error
                    needed[order[~left_out]] = True
                yield pa.RecordBatch.from_arrays([pa.array([batch["qb"][k].as_py()] * int(needed.sum()), pa.string()), pa.array(names[needed].tolist(), pa.string())], ["qb", "tb"])

    rows = pairs.groupBy("qb").agg(*[F.collect_list(c).alias(c) for c in ("tb", "n", "others", "near", "far")])
    return B.mapped(rows, chosen, "qb string, tb string")


def log_kernel_sums(queries: DataFrame, train: DataFrame, bandwidths: list[float], error: float = 0.0) -> DataFrame:
    """node, step, lse, n: for each query (node, features, key) and bandwidth (step: its place in the list) the log of the
    sum of exp(-d^2 / 2h^2) over the training rows (features, key) whose key is another one, and how many those are.
    error: by what share a sum may be low, 0 for none."""
    spark = queries.sparkSession
    size = train.count()
    if not size:
        return spark.createDataFrame([], "node long, step int, lse double, n long")
    tree = space_tree(train, -(-size // LEAF))
    asked = dealt(queries, tree)
    known = dealt(train.select(F.lit(0).cast("long").alias("node"), "key", "features"), tree)
    pairs = meetings(asked, known, bandwidths, error)
    rows = pairs.join(asked.select(F.col("block").alias("qb"), F.col("node").alias("qn"), F.col("key").alias("qk"), F.col("x").alias("qx"), F.size("middle").alias("width")), "qb")
    rows = rows.join(known.select(F.col("block").alias("tb"), F.col("key").alias("tk"), F.col("x").alias("tx")), "tb").select("qn", "qk", "qx", "tk", "tx", "width")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qn, qk, qx, tk, tx, width in B.rows_of(batches, "qn", "qk", "qx", "tk", "tx", "width"):
            nodes, keys, other = (np.frombuffer(v, np.int64) for v in (qn, qk, tk))
            x, y = B.numbers(qx, width), B.numbers(tx, width)
            squares = (y * y).sum(axis=1)
            step = max(1, KERNEL_CELLS // len(y))
            for lo in range(0, len(x), step):
                part = x[lo : lo + step]
                d2 = np.maximum((part * part).sum(axis=1)[:, None] + squares - 2 * (part @ y.T), 0.0)
                mine = keys[lo : lo + step, None]
                d2[(mine == other) & (mine != NO_KEY)] = np.inf
                n = np.isfinite(d2).sum(axis=1)
                some = np.flatnonzero(n)
                least = d2[some].min(axis=1)
                for k, h in enumerate(bandwidths):
                    lse = np.log(np.exp((least[:, None] - d2[some]) / (2 * h * h)).sum(axis=1)) - least / (2 * h * h)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[lo : lo + step][some]), pa.array(np.full(len(some), k, np.int32)), pa.array(lse), pa.array(n[some])], ["node", "step", "t", "n"])

    found = B.mapped(rows, sums, "node long, step int, t double, n long")
    out = log_sum_exp(materialise(found), ["node", "step"], counted=F.sum("n")).select("node", "step", "lse", "n")
    if error <= 0:
        return out
    same = train.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_same"))
    others = queries.select("node", "key").join(same, F.col("key") == F.col("_key"), "left").select("node", (F.lit(size) - F.coalesce("_same", F.lit(0))).alias("n"))
    return out.drop("n").join(others, "node").select("node", "step", "lse", "n")


def log_sum_exp(terms: DataFrame, keys: list[str], term: str = "t", counted: Column | None = None) -> DataFrame:
    """keys, lse, n (the number of terms, or what is counted). Two combinable aggregates: the largest term, then the sum relative to it."""
    top = terms.groupBy(*keys).agg(F.max(term).alias("top"))
    joined = terms.join(top, keys)
    return joined.groupBy(*keys).agg((F.max("top") + F.ln(F.sum(F.exp(F.col(term) - F.col("top"))))).alias("lse"), (F.count("*") if counted is None else counted).alias("n"))
