"""Precision curves, leave-one-out and resampled evaluation."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphnom.plans.tables import materialise

from .ranges import running


def cumulative_precision(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, rank (from 1), node, prob, ind, cum_prec: rows by falling prob (then node) with the share of true ones
    so far. Within `by` if given."""
    own = scored.select(*by, "node", "prob", "ind")
    ranked = running(own, [F.desc("prob"), F.col("node")], {"_true": F.col("ind")}, by)
    return ranked.select(*by, F.col("rank").cast("int").alias("rank"), "node", "prob", "ind", (F.col("_true") / F.col("rank")).alias("cum_prec"))


def mean_cumulative_precision(curve: DataFrame) -> DataFrame:
    """The mean of the curve over all ranks, the guess rate, and the usual average precision (over true ranks)."""
    return curve.agg(F.avg("cum_prec").alias("mean_cum_precision"), F.avg("ind").alias("guess_rate"), F.avg(F.when(F.col("ind") == 1, F.col("cum_prec"))).alias("average_precision"))


def shuffled(node: Column, seed: int | Column) -> Column:
    """A deal of nodes that depends on the seed, by arithmetic that any engine can repeat."""
    return F.pmod(node * 7919 + F.lit(seed) * 104729, F.lit(10007))


def seed_sample(seeds: DataFrame, positives: int, negatives: int, seed: int) -> DataFrame:
    """seeds (node, ind) with train: true for that many of each class, one less than there are at most."""
    drawn = None
    for row in seeds.groupBy("ind").agg(F.count("*").alias("n")).collect():
        most = min(positives if row.ind == 1 else negatives, row.n - 1)
        own = first_dealt(seeds, row.ind, most, seed).select(F.col("node").alias("_node"), F.col("ind").alias("_ind"))
        drawn = own if drawn is None else drawn.unionByName(own)
    if drawn is None:
        return seeds.select("node", "ind", F.lit(False).alias("train"))
    # no more than the given numbers of seeds are drawn
    joined = seeds.join(F.broadcast(drawn), F.col("node").eqNullSafe(F.col("_node")) & F.col("ind").eqNullSafe(F.col("_ind")), "left")
    return joined.select("node", "ind", F.col("_ind").isNotNull().alias("train"))


def first_dealt(seeds: DataFrame, ind: float, most: int, seed: int) -> DataFrame:
    """The first of one class in the deal: each partition keeps that many, and those are merged."""
    return seeds.where(F.col("ind") == ind).select("node", "ind").orderBy(shuffled(F.col("node"), seed), "node").limit(most)


def interleaved(seeds: DataFrame, cv_max: int, seed: int) -> DataFrame:
    """place, node, ind: true and false seeds in turn, each dealt, the first cv_max of them."""
    known = seeds.where("node is not null")
    rows = first_dealt(known, 1.0, cv_max, seed).unionByName(first_dealt(known, 0.0, cv_max, seed))  # cv_max of each at most
    turn = F.row_number().over(Window.partitionBy("ind").orderBy(shuffled(F.col("node"), seed), "node"))
    rows = rows.select("node", "ind", turn.alias("turn")).orderBy("turn", F.desc("ind")).limit(cv_max)
    return rows.select(F.row_number().over(Window.orderBy("turn", F.desc("ind"))).alias("place"), "node", "ind")


def leave_one_out_bayes(seeds: DataFrame, held: DataFrame | None = None, smoothing: float = 1e-9) -> DataFrame:
    """node, ind, prob: each seed under Gaussian naive Bayes of all others, from sums less its own share."""
    from .models import sigmoid

    rows = seeds.select("node", F.col("ind").alias("ind"), F.posexplode("features").alias("pos", "x"))
    sums = rows.groupBy("ind", "pos").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    least = rows.groupBy("pos").agg(F.var_pop("x").alias("v")).agg(F.max("v").alias("least"))
    total = seeds.agg(F.count("*").alias("total"))
    asked = rows if held is None else rows.join(held.select("node"), "node", "left_semi")
    both = asked.withColumnRenamed("ind", "own").join(sums.withColumnRenamed("ind", "label"), "pos")
    mine = (F.col("own") == F.col("label")).cast("double")
    n = F.col("n") - mine
    mean = (F.col("s") - mine * F.col("x")) / n
    var = (F.col("q") - mine * F.col("x") * F.col("x")) / n - mean * mean + F.col("_add")
    term = -0.5 * F.log(2 * F.lit(3.141592653589793) * var) - (F.col("x") - mean) * (F.col("x") - mean) / (2 * var)
    scored = both.crossJoin(F.broadcast(least.select((F.col("least") * smoothing).alias("_add"))))
    per = scored.groupBy("node", "own", "label").agg(F.sum(term).alias("ll"), F.max(n).alias("n"))
    per = per.crossJoin(F.broadcast(total)).select("node", "own", "label", (F.col("ll") + F.log(F.col("n") / (F.col("total") - 1))).alias("j"))
    odds = per.groupBy("node", "own").agg((F.max(F.when(F.col("label") == 1, F.col("j"))) - F.max(F.when(F.col("label") == 0, F.col("j")))).alias("score"))
    return odds.select("node", F.col("own").alias("ind"), sigmoid(F.col("score")).alias("prob"))


def leave_one_out(seeds: DataFrame, held: DataFrame, classify: Callable[[DataFrame, DataFrame], DataFrame], jobs: int = 4) -> DataFrame:
    """node, ind, prob by one refit for each held-out seed (held has at most cv_max of them), `jobs` at a time."""

    def one(row) -> list[tuple]:
        train, test = seeds.where(F.col("node") != row.node), seeds.where(F.col("node") == row.node)
        return [(r.node, float(row.ind), float(r.prob)) for r in classify(train, test).select("node", "prob").collect()]

    with ThreadPoolExecutor(max(1, jobs)) as pool:
        found = [r for rows in pool.map(one, held.select("node", "ind").collect()) for r in rows]
    return seeds.sparkSession.createDataFrame(found, "node long, ind double, prob double")


def resampled(seeds: DataFrame, samples: int, positives: int, negatives: int, top: int, classify: Callable[[DataFrame, DataFrame], DataFrame], jobs: int = 4) -> DataFrame:
    """Monte-Carlo precision curve of any classifier: each sample is trained on its own draw of the seeds and ranks the
    others. The fits of `jobs` samples run at a time; only curves of `top` ranks are kept of each."""

    def one(sample: int) -> DataFrame:
        drawn = seeds.join(seed_sample(seeds, positives, negatives, sample).select("node", "train"), "node")
        test = drawn.where("not train")
        scored = classify(drawn.where("train"), test).join(test.select("node", "ind"), "node")
        curve = cumulative_precision(scored.select("node", "prob", "ind")).where(F.col("rank") <= top)
        return materialise(curve.select(F.lit(sample).cast("long").alias("sample"), "rank", "cum_prec"))

    with ThreadPoolExecutor(max(1, jobs)) as pool:
        curves = list(pool.map(one, range(samples)))
    return resampled_curve(reduce(DataFrame.unionByName, curves), top)


def highest(curves: DataFrame) -> float:
    """The largest mean precision of all curves: the upper end of a plot of them, with a tenth more, 1 at most."""
    return min(1.0, 1.1 * (curves.agg(F.max("mean_prec")).first()[0] or 0.0))


def resampled_curve(curves: DataFrame, top: int) -> DataFrame:
    """curves: sample, rank, cum_prec. Mean and standard error by rank over samples, with bands of two errors."""
    by = curves.where(F.col("rank") <= top).groupBy("rank").agg(F.avg("cum_prec").alias("mean_prec"), (F.stddev_pop("cum_prec") / F.sqrt(F.count("*").cast("double"))).alias("stderr_prec"))
    return by.withColumns({"low": F.col("mean_prec") - 2 * F.col("stderr_prec"), "high": F.col("mean_prec") + 2 * F.col("stderr_prec")})


def draws(seeds: DataFrame, samples: int, positives: int, negatives: int) -> DataFrame:
    """The seeds once for each sample (from 0), with train: whether that sample's draw has them for training."""
    numbered = seeds.crossJoin(F.broadcast(seeds.sparkSession.range(samples).withColumnRenamed("id", "sample")))
    by = Window.partitionBy("sample", "ind")
    at = F.row_number().over(by.orderBy(shuffled(F.col("node"), F.col("sample")), "node"))
    most = F.least(F.when(F.col("ind") == 1, F.lit(positives)).otherwise(F.lit(negatives)), F.count("*").over(by) - 1)
    return numbered.withColumn("train", at <= most)


def resampled_boost(seeds: DataFrame, samples: int, positives: int, negatives: int, top: int, rounds: int = 100) -> DataFrame:
    """Monte-Carlo precision curve of boosted stumps: all samples at once, each trained on its own draw."""
    from .models import boosted_samples

    drawn = materialise(draws(seeds, samples, positives, negatives).select("sample", "node", F.col("ind").cast("double").alias("ind"), "features", "train"))
    return resampled_curve(cumulative_precision(boosted_samples(drawn, rounds), ("sample",)), top)


def resampled_bayes(seeds: DataFrame, samples: int, positives: int, negatives: int, top: int, smoothing: float = 1e-9) -> DataFrame:
    """Monte-Carlo precision curve of naive Bayes: all samples at once, each trained on its own draw."""
    drawn = draws(seeds, samples, positives, negatives)
    long = drawn.select("sample", "node", "ind", "train", F.posexplode("features").alias("pos", "x"))
    fit = long.where("train")
    least = fit.groupBy("sample", "pos").agg(F.var_pop("x").alias("v")).groupBy("sample").agg((F.max("v") * smoothing).alias("_add"))
    stats = fit.groupBy("sample", F.col("ind").alias("label"), "pos").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count("*").alias("n"))
    stats = stats.join(least, "sample").withColumn("v", F.col("v") + F.col("_add"))
    term = -0.5 * F.log(2 * F.lit(3.141592653589793) * F.col("v")) - (F.col("x") - F.col("m")) * (F.col("x") - F.col("m")) / (2 * F.col("v"))
    joint = long.where("not train").join(stats, ["sample", "pos"]).groupBy("sample", "node", "ind", "label").agg((F.sum(term) + F.log(F.max("n").cast("double"))).alias("j"))
    odds = joint.groupBy("sample", "node", "ind").agg((F.max(F.when(F.col("label") == 1, F.col("j"))) - F.max(F.when(F.col("label") == 0, F.col("j")))).alias("prob"))
    return resampled_curve(cumulative_precision(odds, ("sample",)), top)


#: Fixed values: (positive, negative) training seeds of the sweep.
SEED_SETTINGS = [(10, 5), (5, 20), (20, 40), (50, 50), (200, 400), (400, 400), (800, 1600)]


def harness_runs(values: DataFrame, settings: list[tuple[int, int]] | None = None) -> DataFrame:
    """values (type, val, freq) times the settings, where the value is frequent enough: freq >= 2 x positives."""
    table = values.sparkSession.createDataFrame(settings or SEED_SETTINGS, "pos_seeds int, neg_seeds int")
    return values.select("type", "val", "freq").crossJoin(F.broadcast(table)).where(F.col("freq") >= 2 * F.col("pos_seeds"))
