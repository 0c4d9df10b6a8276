"""Classifiers of nodes: (node, features, ind) to (node, prob) for the rows whose ind is null, or all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphnom.plans.shipping import ship_package
from graphnom.plans.tables import free, materialise

from . import blocks
from .features import log_density_constant
from .kernels import log_kernel_sums


def _ready(df: DataFrame) -> DataFrame:
    return df.withColumn("vector", array_to_vector(F.col("features")))


def logreg_weights(train: DataFrame, c: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights, the intercept's last, of L2-penalised logistic regression whose intercept is penalised too, by Newton steps. A step is one pass that
    returns the gradient and curvature of each task, as many numbers as the features squared. (The library's
    estimator gives a constant feature no weight, so it cannot penalise an intercept.)"""
    ship_package(train.sparkSession)
    rows = materialise(train.select("features", F.col("ind").cast("double").alias("ind")))
    first = rows.select(F.size("features")).first()
    width = first[0] + 1
    w = np.zeros(width)

    def at(weights: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + width + width * width)
            for batch in batches:
                x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
                x, y = np.hstack([x, np.ones((len(x), 1))]), np.asarray(batch.column(1), float)
                score = x @ weights
                p = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
                loss = np.logaddexp(0, score) - y * score
                total += np.concatenate([[loss.sum()], x.T @ (p - y), (x.T @ (x * (p * (1 - p))[:, None])).reshape(-1)])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        sums = rows.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
        flat = np.zeros(1 + width + width * width)
        for r in sums:
            flat[r.at] = r.x
        return flat[0] + weights @ weights / (2 * c), flat[1 : 1 + width] + weights / c, flat[1 + width :].reshape(width, width) + np.eye(width) / c

    loss, gradient, curvature = at(w)
    for _ in range(steps):
        move, size = np.linalg.solve(curvature, gradient), 1.0
        while True:  # halve a step that goes too far
            found = at(w - size * move)
            if found[0] <= loss + 1e-12 or size < 1e-4:
                break
            size /= 2
        w = w - size * move
        done = loss - found[0] <= 1e-10 * max(1.0, abs(loss))
        loss, gradient, curvature = found
        if done:
            break
    return w


def logreg_chance(w: np.ndarray) -> Column:
    """The probability that such weights give the column features."""
    weights = F.array(*[F.lit(float(v)) for v in w[:-1]])
    return sigmoid(F.aggregate(F.zip_with("features", weights, lambda x, v: x * v), F.lit(float(w[-1])), lambda s, v: s + v))


def logreg(train: DataFrame, test: DataFrame, c: float = 1.0, steps: int = 50) -> DataFrame:
    return test.select("node", logreg_chance(logreg_weights(train, c, steps)).alias("prob"))


#: How small each entry of a left-out model's gradient is made, and how many passes that may take.
FLAT_GRADIENT, FOLD_PASSES = 1e-7, 40


def pulls(rows: DataFrame, weights: np.ndarray, curvature: bool = False) -> np.ndarray:
    """Of many models at once, weights by row, what the rows (features, ind) pull each entry: the sum of (chance - ind)
    times the features and 1. With curvature: of one model, followed by the squared terms. One pass; a task sends on as
    many numbers as there are weights (or weights squared)."""
    ship_package(rows.sparkSession)
    models, width = weights.shape
    shape = (models + width * curvature, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
            x, y = np.hstack([x, np.ones((len(x), 1))]), np.asarray(batch.column(1), float)
            p = 1 / (1 + np.exp(-np.clip(x @ weights.T, -500, 500)))
            total[:models] += (p - y[:, None]).T @ x
            if curvature:
                total[models:] += x.T @ (x * (p * (1 - p)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    return blocks.small(rows.select("features", "ind").mapInArrow(run, "s binary"), shape)


def left_out_weights(seeds: DataFrame, held: DataFrame, c: float = 1.0) -> list[tuple[int, float, np.ndarray, np.ndarray]]:
    """(node, ind, features and 1, weights) of each held-out seed (held: node, few), the weights being of the model of
    all others.

    All these models are solved together, from the model of all seeds and with its curvature less the own row's share:
    a pass gives the exact gradient of each. A model that needs more than FOLD_PASSES is fitted alone.
    """
    rows = materialise(seeds.select("node", "features", F.col("ind").cast("double").alias("ind")))
    own = rows.join(held.select("node"), "node", "left_semi").orderBy("node").collect()
    if not own:
        return []
    x = np.hstack([np.array([r.features for r in own], float), np.ones((len(own), 1))])
    y = np.array([r.ind for r in own])
    full = logreg_weights(rows, c)
    curved = pulls(rows, full[None], True)[1:] + np.eye(len(full)) / c
    chance = 1 / (1 + np.exp(-(x @ full)))
    inverse = [np.linalg.inv(curved - p * (1 - p) * np.outer(v, v)) for p, v in zip(chance, x, strict=True)]
    w = np.tile(full, (len(own), 1))
    for _ in range(FOLD_PASSES):
        p = 1 / (1 + np.exp(-np.clip((x * w).sum(axis=1), -500, 500)))
        gradient = pulls(rows, w) - (p - y)[:, None] * x + w / c
        if np.abs(gradient).max() <= FLAT_GRADIENT:
            break
        w = w - np.einsum("fij,fj->fi", np.array(inverse), gradient)
    for k in np.flatnonzero(~(np.abs(gradient).max(axis=1) <= 100 * FLAT_GRADIENT)).tolist():
        w[k] = logreg_weights(rows.where(F.col("node") != own[k].node), c)
    return [(r.node, r.ind, x[k], w[k]) for k, r in enumerate(own)]


def left_out_logreg(seeds: DataFrame, held: DataFrame, c: float = 1.0) -> DataFrame:
    """node, ind, prob of the held-out seeds, each under logistic regression of all others."""
    found = [(int(node), float(ind), float(1 / (1 + np.exp(-(x @ w))))) for node, ind, x, w in left_out_weights(seeds, held, c)]
    return seeds.sparkSession.createDataFrame(found, "node long, ind double, prob double")


def class_moments(train: DataFrame, smoothing: float = 1e-9) -> DataFrame:
    """label, pos, mean, var: of each class and place; the variance is of the population plus a share of the
    largest place's variance, so that none is 0."""
    rows = train.select(F.col("ind").cast("int").alias("label"), F.posexplode("features").alias("pos", "x"))
    least = rows.groupBy("pos").agg(F.var_pop("x").alias("v")).agg(F.max("v")).first()[0] or 0.0
    return rows.groupBy("label", "pos").agg(F.avg("x").alias("mean"), (F.var_pop("x") + smoothing * least).alias("var"))


def naive_bayes(train: DataFrame, test: DataFrame) -> DataFrame:
    """Gaussian naive Bayes in closed form."""
    stats = class_moments(train).collect()  # two rows for each place
    counts = {r.label: r.n for r in train.groupBy(F.col("ind").cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    width = 1 + max(r.pos for r in stats)
    table = {(r.label, r.pos): (r["mean"], r["var"]) for r in stats}
    total = sum(counts.values())

    def joint(label: int) -> Column:
        mean, var = (F.array(*[F.lit(float(table[label, p][k])) for p in range(width)]) for k in (0, 1))
        constant = math.log(counts[label] / total) - 0.5 * sum(math.log(2 * math.pi * table[label, p][1]) for p in range(width))
        zipped = F.arrays_zip(F.col("features").alias("x"), mean.alias("m"), var.alias("v"))
        return F.lit(constant) - F.aggregate(zipped, F.lit(0.0), lambda a, r: a + (r["x"] - r["m"]) * (r["x"] - r["m"]) / (2 * r["v"]))

    return test.select("node", sigmoid(joint(1) - joint(0)).alias("prob"))


def sigmoid(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


#: Rows times trees that are grown at once: the driver holds these trees, whose nodes grow with the rows.
GROWN = 2_000_000


def random_forest(train: DataFrame, test: DataFrame, trees: int = 100, seed: int = 123) -> DataFrame:
    """Trees are independent, so a forest of many rows is grown some trees at a time, each lot from its own seed. A lot
    scores the rows and is let go; the probability is the mean over all trees."""

    def grown(known: DataFrame, many: int, lot: int):
        return RandomForestClassifier(featuresCol="vector", labelCol="ind", numTrees=many, maxDepth=30, featureSubsetStrategy="sqrt", seed=seed + lot).fit(known)

    chance = F.element_at(vector_to_array("probability"), 2)
    each = max(1, GROWN // max(1, train.count()))
    if each >= trees:
        return grown(_ready(train), trees, 0).transform(_ready(test)).select("node", chance.alias("prob"))
    known = materialise(_ready(train).select("vector", "ind"))
    asked = materialise(_ready(test).select("node", "vector", F.monotonically_increasing_id().alias("_row")))
    votes = None
    for lot, first in enumerate(range(0, trees, each)):
        many = min(each, trees - first)
        model = grown(known, many, lot)
        own = materialise(model.transform(asked).select("_row", "node", F.lit(lot).alias("lot"), (many * chance).alias("p")))
        votes = own if votes is None else votes.unionByName(own)
        del model
        free(train.sparkSession)
    lots = F.array_sort(F.collect_list(F.struct("lot", "p")))  # summed in order, so that equal rows stay equal
    return votes.groupBy("_row", "node").agg((F.aggregate(lots, F.lit(0.0), lambda s, v: s + v["p"]) / trees).alias("prob")).select("node", "prob")


#: Cuts of each feature that a stump may split at.
STUMP_CUTS = 31


def stump_cuts(train: DataFrame) -> np.ndarray:
    """Quantiles of each place of the features: (place, cut)."""
    rows = train.select(F.posexplode("features").alias("pos", "x")).groupBy("pos").agg(F.percentile_approx("x", [k / (STUMP_CUTS + 1) for k in range(1, STUMP_CUTS + 1)], 10_000).alias("cuts")).collect()
    return np.array([r.cuts for r in sorted(rows, key=lambda r: r.pos)], float)


def stump_votes(x: np.ndarray, stumps: list[tuple[int, float, float, float]]) -> np.ndarray:
    """The sum of the votes of stumps (place, cut, vote up to the cut, vote above it) for each row."""
    out = np.zeros(len(x))
    for place, cut, low, high in stumps:
        out += np.where(x[:, place] <= cut, low, high)
    return out


def class_weights_below(x: np.ndarray, label: np.ndarray, w: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """By class, place and how many of its cuts lie below the value: the weights of the rows."""
    width, many = cuts.shape
    total = np.zeros((2, width, many + 1))
    for place in range(width):
        at = np.searchsorted(cuts[place], x[:, place], "left")
        for k in (0, 1):
            total[k, place] += np.bincount(at[label == k], w[label == k], many + 1)
    return total


def next_stump(total: np.ndarray, cuts: np.ndarray) -> tuple[int, float, float, float] | None:
    """The stump (place, cut, vote up to the cut, vote above it) whose leaves are purest by Gini, of equal ones that of
    the first place, then of the least cut; None if no split helps. total: as class_weights_below gives it."""
    if not np.isfinite(total).all() or not total.sum():
        return None
    low = total.cumsum(axis=2)[:, :, :-1] / total[:, :1].sum()
    high = (total.sum(axis=2, keepdims=True) / total[:, :1].sum()) - low
    purity = sum(2 * side[0] * side[1] / np.maximum(side.sum(axis=0), 1e-300) for side in (low, high))
    place, cut = np.unravel_index(int(np.round(purity, 12).argmin()), purity.shape)
    if min(low[:, place, cut].sum(), high[:, place, cut].sum()) <= 0:
        return None
    share = [np.clip(side[1, place, cut] / max(side[:, place, cut].sum(), 1e-300), 1e-12, 1 - 1e-12) for side in (low, high)]
    return int(place), float(cuts[place, cut]), *(0.5 * math.log(q / (1 - q)) for q in share)


def few_stumps(x: np.ndarray, label: np.ndarray, rounds: int) -> list[tuple[int, float, float, float]]:
    """The stumps of as few rows as a sample draws, in one task: the cuts are the same quantiles of the rows."""
    at = np.ceil(np.arange(1, STUMP_CUTS + 1) / (STUMP_CUTS + 1) * len(x)).astype(int) - 1
    cuts = np.sort(x, axis=0)[at].T
    votes, stumps = np.zeros(len(x)), []
    for _ in range(rounds):
        found = next_stump(class_weights_below(x, label, np.exp(-(2 * label - 1) * votes), cuts), cuts)
        if found is None:
            break
        stumps.append(found)
        votes += stump_votes(x, [found])
    return stumps


def boosted_samples(drawn: DataFrame, rounds: int = 100) -> DataFrame:
    """drawn: sample, node, ind, features, train. sample, node, ind, prob of the rows that are not for training, each under
    the boosted stumps of its sample: all samples are fitted in one pass, each in one task, as a sample draws a given
    number of rows, and all rows are scored in another."""
    ship_package(drawn.sparkSession)

    def fit(rows: pa.Table) -> pa.Table:
        x = np.array(rows["features"].to_pylist(), float)
        stumps = few_stumps(x, np.asarray(rows["ind"], float).astype(np.int64), rounds)
        own = [list(map(float, v)) for v in zip(*stumps, strict=True)] or [[]] * 4
        return pa.table({"sample": rows["sample"][:1], **{k: pa.array([v], pa.list_(pa.float64())) for k, v in zip(("place", "cut", "low", "high"), own, strict=True)}})

    fitted = drawn.where("train").select("sample", "features", "ind").groupBy("sample").applyInArrow(fit, "sample long, place array<double>, cut array<double>, low array<double>, high array<double>")
    # a few numbers for each round and sample
    stumps = {r.sample: [(int(p), *v) for p, *v in zip(r.place, r.cut, r.low, r.high, strict=True)] for r in fitted.collect()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sample = batch["sample"].to_numpy()
            x = np.asarray(batch["features"].flatten(), float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            votes = np.zeros(batch.num_rows)
            for s in np.unique(sample).tolist():
                votes[sample == s] = stump_votes(x[sample == s], stumps.get(s, []))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("sample", "node", "ind")], pa.array(1 / (1 + np.exp(-2 * votes)))], ["sample", "node", "ind", "prob"])

    return drawn.where("not train").select("sample", "node", "ind", "features").mapInArrow(score, "sample long, node long, ind double, prob double")


def boosted_stumps(train: DataFrame, test: DataFrame, rounds: int = 100, seed: int = 123) -> DataFrame:
    """AdaBoost of depth-1 trees with real-valued votes: each round votes half the log odds of its leaf, and rows
    gain weight by how wrong the votes have been. A round is one pass over the rows that returns the weights of each
    class below each cut; a row's weight comes from the stumps so far. (No draw is made: seed has no effect.)"""
    ship_package(train.sparkSession)
    rows = materialise(train.select("features", F.col("ind").cast("double").alias("ind")))
    cuts = stump_cuts(rows)
    width, many = cuts.shape
    stumps: list[tuple[int, float, float, float]] = []

    def weights_below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width, many + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
            label = np.asarray(batch.column(1), float).astype(np.int64)
            total += class_weights_below(x, label, np.exp(-(2 * label - 1) * stump_votes(x, stumps)), cuts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["at", "w"])

    for _ in range(rounds):
        total = np.zeros(2 * width * (many + 1))
        for r in rows.mapInArrow(weights_below, "at long, w double").groupBy("at").agg(F.sum("w").alias("w")).collect():
            total[r["at"]] = r.w
        found = next_stump(total.reshape(2, width, many + 1), cuts)
        if found is None:
            break
        stumps.append(found)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-2 * stump_votes(x, stumps))))], ["node", "prob"])

    return test.select("node", "features").mapInArrow(score, "node long, prob double")


class TwoClassKDE:
    """Two kernel density estimates and the odds of their classes. Rows: node, features, ind. error: by what share a
    density may be low, 0 for none."""

    def __init__(self, bandwidths: tuple[float, float] = (1.0, 1.0), width: int | None = None, error: float = 0.0):
        self.bandwidths, self.width, self.error = tuple(bandwidths), width, error
        self.train: DataFrame | None = None
        self.counts = (0, 0)

    def get_params(self) -> dict[str, float]:
        return {"bandwidth": self.bandwidths[0]}

    def set_params(self, bandwidth: float) -> TwoClassKDE:
        self.bandwidths = (bandwidth, bandwidth)
        return self

    def fit(self, train: DataFrame) -> TwoClassKDE:
        rows = train.select("node", "features", "ind")
        found = {r.ind: r.n for r in rows.groupBy("ind").agg(F.count("*").alias("n")).collect()}
        if set(found) - {0.0, 1.0}:
            raise ValueError("labels must be 0 or 1")
        self.train, self.counts = rows, (found.get(0.0, 0), found.get(1.0, 0))
        self.width = self.width or len(rows.first().features)
        return self

    def fit_with_optimal_bandwidth(self, train: DataFrame, gridsize: int = 101, dynamic_range: float = 100.0, cv: int = 10) -> TwoClassKDE:
        """Each class takes the bandwidth of its grid that its held-out folds are likeliest under."""
        self.fit(train)
        best = bandwidth_scores(train, self.width, gridsize, dynamic_range, cv).groupBy("label").agg(F.max_by("bandwidth", F.struct("score", -F.col("bandwidth"))).alias("h")).collect()
        by = {r.label: r.h for r in best}
        self.bandwidths = (by.get(0, 1.0), by.get(1, 1.0))
        return self

    @property
    def log_odds(self) -> float:
        """Of the classes, with one more of each."""
        return math.log((self.counts[1] + 1) / (self.counts[0] + 1))

    def log_densities(self, queries: DataFrame, exclude_self: bool = False) -> DataFrame:
        """node, s0, s1: log densities; of an empty class 0."""
        key = F.col("node") if exclude_self else F.lit(None).cast("long")
        asked, known = queries.select("node", "features", key.alias("key")), self.train.select("node", "features", F.col("node").alias("key"), F.col("ind").cast("int").alias("label"))
        per = None
        for label in (0, 1):
            own = log_kernel_sums(asked, known.where(F.col("label") == label), [self.bandwidths[label]], self.error).withColumn("label", F.lit(label))
            per = own if per is None else per.unionByName(own)
        constant = F.when(F.col("label") == 1, log_density_constant(self.width, self.bandwidths[1])).otherwise(log_density_constant(self.width, self.bandwidths[0]))
        wide = per.groupBy("node").agg(*[F.max(F.when(F.col("label") == k, F.col("lse") - F.ln("n") + constant)).alias(f"s{k}") for k in (0, 1)])
        return queries.select("node").join(wide, "node", "left").select("node", F.coalesce("s0", F.lit(0.0)).alias("s0"), F.coalesce("s1", F.lit(0.0)).alias("s1"))

    def score_samples(self, queries: DataFrame, exclude_self: bool = False) -> DataFrame:
        """node, score: the log ratio of the densities plus the classes' log odds."""
        return self.log_densities(queries, exclude_self).select("node", (F.col("s1") - F.col("s0") + self.log_odds).alias("score"))

    def score(self, queries: DataFrame) -> float:
        return self.score_samples(queries).agg(F.sum("score")).first()[0]

    def predict_proba(self, queries: DataFrame, exclude_self: bool = False) -> DataFrame:
        """node, p0, p1."""
        return self.score_samples(queries, exclude_self).select("node", (1 / (1 + F.exp("score"))).alias("p0")).withColumn("p1", 1 - F.col("p0"))

    def predict_log_proba(self, queries: DataFrame) -> DataFrame:
        return self.predict_proba(queries).select("node", F.ln("p0").alias("l0"), F.ln("p1").alias("l1"))


def fold(node: Column, cv: int) -> Column:
    """The fold of a node: arithmetic, so that another engine can repeat it."""
    return F.pmod(node * 7919, F.lit(10007)) % cv


def pooled_sigma(rows: DataFrame) -> DataFrame:
    """label, n, sigma: deviation of all entries of a class from their place's mean in it."""
    long = rows.select(F.col("ind").cast("int").alias("label"), "node", F.posexplode("features").alias("pos", "x"))
    by = long.groupBy("label", "pos").agg(F.var_pop("x").alias("v"), F.count("*").alias("n"))
    return by.groupBy("label").agg(F.max("n").alias("n"), F.sqrt(F.avg("v")).alias("sigma"))


def bandwidth_grid(rows: DataFrame, gridsize: int, dynamic_range: float) -> DataFrame:
    """label, step, bandwidth: a geometric grid about 1.06 sigma n^(-1/5) that spans dynamic_range."""
    centre = 1.06 * F.col("sigma") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    steps = pooled_sigma(rows).select("label", centre.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("step"))
    exponent = F.col("step") / float(max(gridsize - 1, 1)) - 0.5
    return steps.select("label", "step", (F.col("b") * F.pow(F.lit(float(dynamic_range)), exponent)).alias("bandwidth"))


def bandwidth_scores(rows: DataFrame, width: int, gridsize: int = 31, dynamic_range: float = 100.0, cv: int = 10) -> DataFrame:
    """label, bandwidth, score: the log-likelihood of each row under the rows of its class in other folds."""
    own = rows.select("node", "features", F.col("ind").cast("int").alias("label"), fold(F.col("node"), cv).cast("long").alias("key"))
    grid = bandwidth_grid(rows, gridsize, dynamic_range).collect()  # gridsize rows for each class
    out = None
    for label in sorted({r.label for r in grid}):
        steps = [r.bandwidth for r in sorted((r for r in grid if r.label == label), key=lambda r: r.step)]
        one = own.where(F.col("label") == label)
        h = F.element_at(F.array(*[F.lit(float(x)) for x in steps]), F.col("step") + 1)
        scored = log_kernel_sums(one, one, steps).select(F.lit(label).alias("label"), h.alias("bandwidth"), "lse", "n")
        out = scored if out is None else out.unionByName(scored)
    constant = -0.5 * width * math.log(2 * math.pi) - width * F.ln("bandwidth")
    return out.groupBy("label", "bandwidth").agg(F.sum(F.col("lse") - F.ln("n") + constant).alias("score"))


def gaussian_mixture(spark, n: int, width: int, seed: int = 0) -> DataFrame:
    """Sample rows of two Gaussian classes, one shifted: for demonstrations and tests."""
    rng = np.random.default_rng(seed)
    rows = [(k, [float(v) for v in rng.normal(1.5 * (k % 2), 1 + 0.5 * (k % 2), width)], float(k % 2)) for k in range(n)]
    return spark.createDataFrame(rows, "node long, features array<double>, ind double")


def kde(train: DataFrame, test: DataFrame, gridsize: int = 31, dynamic_range: float = 100.0, cv: int = 10) -> DataFrame:
    return TwoClassKDE().fit_with_optimal_bandwidth(train, gridsize, dynamic_range, cv).predict_proba(test).select("node", F.col("p1").alias("prob"))


#: By name: (train, test) to (node, prob).
CLASSIFIERS = {"logreg": logreg, "naive_bayes": naive_bayes, "randfor": random_forest, "boost": boosted_stumps, "kde": kde}


def classify(name: str, train: DataFrame, test: DataFrame, **options) -> DataFrame:
    if name not in CLASSIFIERS:
        raise ValueError(f"no classifier {name!r}")
    return CLASSIFIERS[name](train, test, **options)
