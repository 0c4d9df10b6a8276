"""Ranks and running sums by ranges, drawn seeds: against plain loops, and no task that holds all."""

import random

import pytest
from graphnom.operators import evaluate, spectral
from graphnom.operators.ranges import running
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("by", [(), ("kind",)])
def test_running_sums(spark, by):
    rnd = random.Random(len(by))
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randint(0, 6), k, rnd.choice([None, 1.5, -2.0, 4.0])) for k in range(300)]
    rows += [("lonely", 1, 1000, None)]
    table = spark.createDataFrame(rows, "kind string, x int, id long, v double")
    out = running(table, [F.desc("x"), F.col("id")], {"total": F.col("v"), "squares": F.col("v") * F.col("v")}, by)
    got = {r.id: (r["rank"], r.total, r.squares) for r in out.collect()}
    seen = {}
    for kind, _, k, v in sorted(rows, key=lambda r: (-r[1], r[2])):
        key = kind if by else 0
        rank, total, squares = seen.get(key, (0, None, None))
        if v is not None:
            total, squares = (total or 0) + v, (squares or 0) + v * v
        seen[key] = (rank + 1, total, squares)
        assert got[k] == seen[key]
    assert running(table.where("false"), [F.col("id")], {"total": F.col("v")}, by).count() == 0
    assert "SinglePartition" not in plan_of(out)


def test_curves_and_profiles_have_no_single_task(spark):
    scored = spark.createDataFrame([(k, (k * 37 % 11) / 11, float(k % 3 == 0)) for k in range(200)], "node long, prob double, ind double")
    curve = evaluate.cumulative_precision(scored)
    assert "SinglePartition" not in plan_of(curve)
    hits = 0.0
    for k, r in enumerate(sorted(scored.collect(), key=lambda r: (-r.prob, r.node)), 1):
        hits += r.ind
        assert curve.where(F.col("node") == r.node).first().asDict() == {"rank": k, "node": r.node, "prob": r.prob, "ind": r.ind, "cum_prec": hits / k} if k % 40 == 0 else True
    scree = spark.createDataFrame([(k, 100.0 / k) for k in range(1, 60)], "k long, x double")
    profile = spectral.elbow_profile(scree)
    assert "SinglePartition" not in plan_of(profile)
    best = max(profile.collect(), key=lambda r: r.ll).k
    assert spectral.elbows([100.0 / k for k in range(1, 60)]) == [best - 1]


def test_drawn_seeds(spark):
    rows = [(k, float(k % 5 == 0)) for k in range(400)]
    seeds = spark.createDataFrame(rows, "node long, ind double")
    drawn = {r.node: r.train for r in evaluate.seed_sample(seeds, 30, 1000, 3).collect()}
    deal = lambda k: ((k * 7919 + 3 * 104729) % 10007, k)
    true, false = (sorted((k for k, ind in rows if ind == v), key=deal) for v in (1.0, 0.0))
    assert {k for k, train in drawn.items() if train} == {*true[:30], *false[:-1]} and len(drawn) == 400
    taken = [(r.place, r.node, r.ind) for r in evaluate.interleaved(seeds, 9, 3).orderBy("place").collect()]
    want = [x for pair in zip([(k, 1.0) for k in true], [(k, 0.0) for k in false], strict=False) for x in pair][:9]
    assert taken == [(p, *x) for p, x in enumerate(want, 1)]
    for df in (evaluate.seed_sample(seeds, 30, 40, 3),):
        assert "Window" not in plan_of(df) and "TakeOrderedAndProject" in plan_of(df)
    assert evaluate.seed_sample(seeds.where("false"), 3, 3, 1).count() == 0 and evaluate.interleaved(seeds.where("false"), 3, 1).count() == 0
