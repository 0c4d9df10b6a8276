"""Classifiers and evaluation against plain numpy, and a run from files to a ranked list."""

import json
import math

import numpy as np
import pytest
from graphnom.__main__ import main, parser
from graphnom.config import Config, Dtype, from_json, parse_items
from graphnom.functions.text import legend, time_format, timed, underscored
from graphnom.operators import evaluate, features, kernels, models
from graphnom.plans import nomination, tables
from graphnom.sources import readers, writers
from graphnom.streaming.incremental import RunningCounts, stream_frequencies, stream_pair_counts
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def sample(spark):
    return models.gaussian_mixture(spark, 60, 3, 1).cache()


def arrays(df):
    rows = df.orderBy("node").collect()
    return np.array([r.features for r in rows]), np.array([r.ind for r in rows])


def bayes(x, y, q):
    out = []
    least = x.var(axis=0).max() * 1e-9
    for k in (0, 1):
        own = x[y == k]
        v = own.var(axis=0) + least
        out.append(-0.5 * (np.log(2 * np.pi * v) + (q - own.mean(axis=0)) ** 2 / v).sum() + math.log(len(own) / len(x)))
    return 1 / (1 + math.exp(out[0] - out[1]))


def test_naive_bayes_and_leaving_one_out(sample):
    x, y = arrays(sample)
    got = {r.node: r.prob for r in models.naive_bayes(sample, sample).collect()}
    assert all(got[k] == pytest.approx(bayes(x, y, x[k]), abs=1e-9) for k in range(60))
    loo = {r.node: r.prob for r in evaluate.leave_one_out_bayes(sample).collect()}
    for k in range(60):
        rest = np.arange(60) != k
        assert loo[k] == pytest.approx(bayes(x[rest], y[rest], x[k]), abs=1e-4)
    held = evaluate.interleaved(sample, 4, 1)
    assert [r.ind for r in held.orderBy("place").collect()] == [1, 0, 1, 0]
    refit = {r.node: r.prob for r in evaluate.leave_one_out(sample, held, models.naive_bayes).collect()}
    assert all(refit[k] == pytest.approx(loo[k], abs=1e-4) for k in refit) and len(refit) == 4


def test_kernel_densities(sample):
    x, y = arrays(sample)
    h = 0.7

    def log_density(own, q):
        t = -((own - q) ** 2).sum(axis=1) / (2 * h * h) - 1.5 * math.log(2 * math.pi) - 3 * math.log(h)
        return t.max() + math.log(np.exp(t - t.max()).sum()) - math.log(len(own))

    kde = models.TwoClassKDE((h, h)).fit(sample)
    got = {r.node: r.score for r in kde.score_samples(sample).collect()}
    want = [log_density(x[y == 1], q) - log_density(x[y == 0], q) + math.log(31 / 31) for q in x]
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in range(60))
    assert kde.score(sample) == pytest.approx(sum(want), abs=1e-6)
    p = kde.predict_proba(sample).first()
    assert p.p0 + p.p1 == pytest.approx(1)
    tuned = models.TwoClassKDE().fit_with_optimal_bandwidth(sample, 7, 100.0, 5)
    grid = {(r.label, r.bandwidth): r.score for r in models.bandwidth_scores(sample, 3, 7, 100.0, 5).collect()}
    for k in (0, 1):
        assert grid[k, tuned.bandwidths[k]] == max(v for (label, _), v in grid.items() if label == k)
    with pytest.raises(ValueError):
        models.TwoClassKDE().fit(sample.withColumn("ind", F.lit(2.0)))


@pytest.mark.parametrize("name,options", [("logreg", {}), ("randfor", {"trees": 10}), ("boost", {"rounds": 5})])
def test_learned_classifiers_find_the_classes(sample, name, options):
    scored = models.classify(name, sample, sample, **options).join(sample, "node").collect()
    # the classes overlap; the logistic optimum itself, checked below, places 0.8 of these rows right
    assert np.mean([(r.prob >= 0.5) == (r.ind == 1) for r in scored]) >= 0.75


def test_logistic_regression_reaches_its_optimum(sample):
    x, y = arrays(sample)
    x1, w = np.hstack([x, np.ones((60, 1))]), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ w))
        w -= np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + np.eye(4), x1.T @ (p - y) + w)
    got = {r.node: r.prob for r in models.logreg(sample, sample).collect()}
    assert all(got[k] == pytest.approx(1 / (1 + math.exp(-x1[k] @ w)), abs=1e-3) for k in range(60))


def test_unknown_classifier(sample):
    with pytest.raises(ValueError):
        models.classify("oracle", sample, sample)


def test_features(spark, sample):
    x, _ = arrays(sample)
    z = np.array([r.features for r in features.zscored(sample, 3).orderBy("node").collect()])
    assert np.allclose(z, (x - x.mean(axis=0)) / x.std(axis=0))
    values, projected = features.pca(sample, 3, 2, whiten=True)
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(values, s[:2] ** 2 / 59)
    p = np.array([r.features for r in projected.orderBy("node").collect()])
    assert np.allclose(np.abs(p), np.abs(u[:, :2] * math.sqrt(59)), atol=1e-8)
    rows = spark.createDataFrame([(0, "size", "3"), (1, "size", "x"), (2, "other", "1")], "node long, attributeType string, attributeVal string")
    wide = features.numeric_pivot(rows, ("size",), spark.range(3).withColumnRenamed("id", "node"))
    assert [r["size"] for r in wide.orderBy("node").collect()] == [3.0, None, None]
    assert [r["size"] for r in features.impute(wide, ("size",)).orderBy("node").collect()] == [3.0, 3.0, 3.0]
    with pytest.raises(Exception, match="two values"):
        features.numeric_pivot(rows.unionByName(rows.limit(1)), ("size",)).collect()
    zero = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "node long, features array<double>")
    assert [r.features for r in features.on_sphere(zero).orderBy("node").collect()] == [[0, 0], [0.6, 0.8]]


def test_settings():
    assert Config().nominate_max == 500 and Config().which_elbow == 2
    assert from_json('{"predictor_types": {"size": "numeric", "brand": "categorical"}, "nomination_type": "brand"}').numeric == ("size",)
    for bad in ('{"sim": "no"}', '{"x": 1}', '{"delta": 1.0}'):
        with pytest.raises(ValueError):
            from_json(bad)
    assert parse_items([("a", "3 # three"), ("b", "[1, 'x']"), ("c", "plain")]) == {"a": 3, "b": [1, "x"], "c": "plain"}
    assert time_format(3661.5) == "1h,1m,1.500s" and legend("k", 3) == "k = 3"


def test_from_files_to_a_ranked_list(spark, tmp_path):
    rng = np.random.default_rng(2)
    group = rng.integers(0, 2, 40)
    edges = [(i, j) for i in range(40) for j in range(i) if rng.random() < (0.4 if group[i] == group[j] else 0.05)]
    (tmp_path / "edges.dat").write_text("\n".join(f"{i} {j}" for i, j in edges) + "\n39 39\n\n")
    lines = ["node;attributeType;attributeVal"]
    for k in range(40):
        lines += [f"{k};colour;{'red' if group[k] else 'blue'}"] * (k % 2) + [f"{k};word;w{group[k]}{k % 3}"] + [f"{k};size;{k}"]
    (tmp_path / "attrs.csv").write_text("\n".join(lines) + "\n5;word;\n")
    e, a = readers.read_edges(spark, str(tmp_path / "edges.dat")), readers.read_attributes(spark, str(tmp_path / "attrs.csv"))
    assert e.count() == len(edges) + 1 and a.where("attributeVal is null").count() == 0
    config = Config(predictor_types=(("word", Dtype.CATEGORICAL), ("size", Dtype.NUMERIC)), nomination_type="colour", nomination_value="red", max_eig=4, which_elbow=0, classifier="naive_bayes", cv_max=10, nominate_max=8)
    curve, top = nomination.run(spark, e, a, config, str(tmp_path / "out"))
    assert curve.count() == 10 and top.count() == 8
    assert np.mean([group[r.node] for r in top.collect()]) > 0.7
    assert readers.listing(spark, str(tmp_path / "out"))
    key = writers.embedding_key("adj", 4)
    assert writers.EmbeddingCache(spark, str(tmp_path / "out")).get(key).count() == 40
    assert writers.EmbeddingCache(spark, str(tmp_path / "out")).get(writers.embedding_key("adj", 40)) is None
    with pytest.raises(ValueError):
        readers.read_attributes(spark, str(tmp_path / "attrs.csv"), ("none",))
    (tmp_path / "bad.dat").write_text("1 2\n1 x\n1 2 3\n")
    with pytest.raises(Exception, match="not an edge"):
        readers.read_edges(spark, str(tmp_path / "bad.dat")).collect()
    assert readers.read_edges(spark, str(tmp_path / "bad.dat"), strict=False).count() == 2


@pytest.fixture(scope="module")
def small_graph(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("graph")
    rng = np.random.default_rng(2)
    group = rng.integers(0, 2, 40)
    (folder / "edges.dat").write_text("\n".join(f"{i} {j}" for i in range(40) for j in range(i) if rng.random() < (0.4 if group[i] == group[j] else 0.05)))
    lines = ["node;attributeType;attributeVal"] + [x for k in range(40) for x in ([f"{k};colour;{'red' if group[k] else 'blue'}"] if k % 3 else []) + [f"{k};word;w{group[k]}{k % 3}"]]
    (folder / "attrs.csv").write_text("\n".join(lines) + "\n")
    settings = {"edges_filename": "edges.dat", "attr_filename": "attrs.csv", "predictor_types": {"word": "categorical"}, "nomination_type": "colour", "nomination_value": "red", "max_eig": 3, "which_elbow": 0, "cv_max": 0, "nominate_max": 5, "num_trees": 5, "verbose": False}
    (folder / "params.json").write_text(json.dumps(settings))
    return folder, from_json(json.dumps(settings)), readers.read_edges(spark, str(folder / "edges.dat")), readers.read_attributes(spark, str(folder / "attrs.csv"))


def test_command_line(spark, small_graph):
    folder, _, _, _ = small_graph
    main(["embed", str(folder)], spark)
    main(["nominate", str(folder)], spark)
    names = readers.listing(spark, str(folder))
    assert "colour_red_nomination.out" in names and "attr_report.txt" in names and not any("cv_nomination" in n for n in names)
    ranked = spark.read.option("sep", "\t").option("header", True).csv(str(folder / "colour_red_nomination.out"))
    assert ranked.count() == 5 and ranked.columns[:2] == ["node", "prob"]
    with pytest.raises(SystemExit):
        parser().parse_args(["resample", "x"])
    assert parser().parse_args(["resample", "x", "-a", "red", "-t", "colour"]).num_samples == 50


def test_no_cross_validation(spark, small_graph):
    _, config, edges, attributes = small_graph
    for name in ("logreg", "naive_bayes", "kde"):
        curve, top = nomination.run(spark, edges, attributes, config.with_(classifier=name, kde_grid=3, kde_folds=3))
        assert curve.count() == 0 and top.count() == 5


def test_leaving_out_of_densities_keeps_the_bandwidths(sample):
    config = Config(classifier="kde", kde_grid=5, kde_folds=4, cv_max=20)
    got = {r.node: r.prob for r in nomination.cross_validated(sample, config).collect()}
    assert len(got) == 20
    model = models.TwoClassKDE().fit_with_optimal_bandwidth(sample, 5, 100.0, 4)
    x, y = arrays(sample)
    width = x.shape[1]
    for k, p in got.items():
        rest = np.arange(len(x)) != k
        s = [math.log(np.mean(np.exp(-((x[rest & (y == c)] - x[k]) ** 2).sum(axis=1) / (2 * model.bandwidths[c] ** 2)))) - width * math.log(model.bandwidths[c]) for c in (0, 1)]
        assert p == pytest.approx(1 / (1 + math.exp(-(s[1] - s[0]))), abs=1e-9)


def test_kernel_sums_in_blocks(sample, monkeypatch):
    asked, known = sample.selectExpr("node", "features", "node as key"), sample.selectExpr("features", "node as key")
    x, _ = arrays(sample)
    nodes = [r.node for r in sample.orderBy("node").collect()]
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for leaf in (10_000, 16, 3):  # one block, leaves of a tree, leaves cut into several blocks
        monkeypatch.setattr(kernels, "LEAF", leaf)
        got = {(r.node, r.step): (r.lse, r.n) for r in models.log_kernel_sums(asked, known, [0.5, 0.05]).collect()}
        assert len(got) == 2 * len(x)
        for k, node in enumerate(nodes):
            for step, h in enumerate((0.5, 0.05)):
                t = np.delete(-d2[k] / (2 * h * h), k)
                assert got[node, step] == (pytest.approx(t.max() + np.log(np.exp(t - t.max()).sum())), len(x) - 1)


def test_far_blocks_are_left_out_within_the_error(spark, monkeypatch):
    monkeypatch.setattr(kernels, "LEAF", 40)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(150, 2)) + 40 * k for k in range(4)])
    rows = spark.createDataFrame([(k, x[k].tolist(), k % 5) for k in range(600)], "node long, features array<double>, fold long")
    asked, known = rows.selectExpr("node", "features", "fold as key"), rows.selectExpr("features", "fold as key")
    exact = {r.node: (r.lse, r.n) for r in kernels.log_kernel_sums(asked, known, [1.0]).collect()}
    for error in (1e-9, 0.05):
        near = {r.node: (r.lse, r.n) for r in kernels.log_kernel_sums(asked, known, [1.0], error).collect()}
        assert near.keys() == exact.keys()
        for k, (lse, n) in exact.items():
            assert near[k][1] == n and -np.log1p(-error) + 1e-9 >= lse - near[k][0] >= -1e-9
    tree = kernels.space_tree(known, 16)
    met = kernels.meetings(kernels.dealt(asked, tree), kernels.dealt(known.selectExpr("0L as node", "key", "features"), tree), [1.0], 1e-9)
    blocks_ = kernels.dealt(asked, tree).count()
    assert met.count() < 0.5 * blocks_**2  # the other clusters are not met
    unkeyed = kernels.log_kernel_sums(asked.withColumn("key", F.lit(None).cast("long")), known, [1.0], 1e-9)
    assert {r.n for r in unkeyed.collect()} == {600}


def test_boosted_stumps_by_hand(sample):
    x, y = arrays(sample)
    sign, score = 2 * y - 1, np.zeros(len(y))
    cuts = models.stump_cuts(sample)
    for _ in range(3):
        w = np.exp(-sign * score)
        w /= w.sum()
        best = None
        for f in range(x.shape[1]):
            for c in cuts[f]:
                low = x[:, f] <= c
                leaves = [(w[s & (y == 0)].sum(), w[s & (y == 1)].sum()) for s in (low, ~low)]
                loss = round(sum(2 * a * b / max(a + b, 1e-300) for a, b in leaves), 12)
                if best is None or loss < best[0]:
                    best = (loss, low, leaves)
        q = [np.clip(b / (a + b), 1e-12, 1 - 1e-12) for a, b in best[2]]
        score = score + np.where(best[1], *(0.5 * math.log(v / (1 - v)) for v in q))
    got = {r.node: r.prob for r in models.boosted_stumps(sample, sample, 3).collect()}
    assert all(got[k] == pytest.approx(1 / (1 + math.exp(-2 * score[k]))) for k in range(len(y)))


def test_harness(spark, small_graph, tmp_path):
    _, config, edges, attributes = small_graph
    curves = nomination.harness(spark, edges, attributes, config, 4, 4, 2, 6, classifiers=("logreg", "boost", "naive_bayes"), folder=str(tmp_path))
    rows = curves.collect()
    assert {(r.embedding_info, r.classifier) for r in rows} == {(a, b) for a in nomination.EMBEDDING_CHOICES for b in ("logreg", "boost", "naive_bayes")}
    assert all(r.sphere_content and r.low <= r.mean_prec <= r.high and 1 <= r["rank"] <= 6 for r in rows)
    again = readers.read_precision(spark, nomination.precision_path(str(tmp_path), config, 4, 4))
    assert again.count() == len(rows) and evaluate.highest(again) == pytest.approx(min(1.0, 1.1 * max(r.mean_prec for r in rows)))
    with pytest.raises(ValueError):
        nomination.choice_of_features(spark, edges, attributes, config, "none", True)


def test_tables_are_removed(spark):
    kept = tables.materialise(spark.range(3))
    assert kept.count() == 3 and readers.exists(spark, tables.run_folder(spark))
    path = kept.inputFiles()[0].rsplit("/", 1)[0]
    assert path.rsplit("/", 1)[0].endswith(tables.run_folder(spark).rsplit("/", 1)[1])
    writers.remove(spark, path)
    assert not readers.exists(spark, path) and readers.exists(spark, tables.run_folder(spark))


def test_text_helpers(spark):
    said = []
    assert timed(lambda a: a + 1, said.append)(2) == 3 and said[0].startswith("<lambda>: 0h,0m,")
    assert spark.range(1).select(underscored(F.lit("  new  york ")).alias("t")).first().t == "new_york"


def test_frequencies_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(0, "t", "a"), (1, "t", "a"), (1, "u", "b")], "node long, attributeType string, attributeVal string")
    rows.write.parquet(str(tmp_path / "in"))
    stream_frequencies(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination(60)
    got = RunningCounts(spark, str(tmp_path / "state"), ["type", "val"], "freq").read(0).collect()
    assert {(r.type, r.val): r.freq for r in got} == {("t", "a"): 2, ("u", "b"): 1}


def test_sampling_and_curves(sample):
    drawn = evaluate.seed_sample(sample, 10, 100, 3)
    assert {(r.ind, r.train): r.n for r in drawn.groupBy("ind", "train").agg(F.count("*").alias("n")).collect()} == {(1.0, True): 10, (1.0, False): 20, (0.0, True): 29, (0.0, False): 1}
    curve = evaluate.resampled_bayes(sample, 3, 10, 10, 20).orderBy("rank").collect()
    assert len(curve) == 20 and curve[0].mean_prec > 0.6 and all(r.low <= r.mean_prec <= r.high for r in curve)


def test_counts_of_a_stream(spark, tmp_path):
    folder = tmp_path / "edges"
    values = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "node long, val string")
    for k, rows in enumerate(([(0, 1), (1, 2)], [(0, 2), (0, 3)])):
        spark.createDataFrame(rows, "src long, dst long").coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("src long, dst long").parquet(str(folder))
        stream_pair_counts(stream, values, str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination(60)
        state = RunningCounts(spark, str(tmp_path / "state"), ["a", "b"], "c").read(k)
    assert {(r.a, r.b): r.c for r in state.collect()} == {("a", "b"): 2, ("a", "a"): 1, ("*???*_3", "a"): 1}
    again = RunningCounts(spark, str(tmp_path / "state"), ["a", "b"], "c")
    again.add(spark.createDataFrame([("a", "a", 1), ("*???*_3", "a", 1)], "a string, b string, c long"), 1)
    assert {(r.a, r.b): r.c for r in again.read(1).collect()}["a", "a"] == 1  # a batch twice counts once
    for k in (2, 3):
        again.add(spark.createDataFrame([("a", "a", 1)], "a string, b string, c long"), k)
    assert again.versions() == [2, 3]  # older ones are gone


def test_left_out_models_are_those_of_single_fits(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4))
    y = (x[:, 0] + 0.5 * rng.normal(size=60) > 0).astype(float)
    seeds = spark.createDataFrame([(k, x[k].tolist(), float(y[k])) for k in range(60)], "node long, features array<double>, ind double")
    held = seeds.where("node % 7 = 3").select("node")

    def plain(left_out):
        keep = np.arange(60) != left_out
        a, b, w = np.hstack([x[keep], np.ones((59, 1))]), y[keep], np.zeros(5)
        for _ in range(50):
            p = 1 / (1 + np.exp(-a @ w))
            w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.eye(5), a.T @ (p - b) + w)
        return 1 / (1 + np.exp(-(x[left_out] @ w[:4] + w[4])))

    for passes in (40, 1):  # the second leaves models to be fitted alone
        monkeypatch.setattr(models, "FOLD_PASSES", passes)
        got = {r.node: (r.ind, r.prob) for r in models.left_out_logreg(seeds, held).collect()}
        assert sorted(got) == list(range(3, 60, 7))
        for k, (ind, prob) in got.items():
            assert ind == y[k] and abs(prob - plain(k)) < 1e-5
    assert models.left_out_logreg(seeds, held.where("false")).count() == 0


def test_boosted_samples_are_those_of_single_fits(sample):
    seeds = sample.withColumn("ind", F.col("ind").cast("double"))
    got = {(r.sample, r.node): r.prob for r in models.boosted_samples(evaluate.draws(seeds, 3, 12, 9), 7).collect()}
    assert len(got) == 3 * (60 - 21)
    for k in (0, 2):
        drawn = seeds.join(evaluate.seed_sample(seeds, 12, 9, k).select("node", "train"), "node")
        for r in models.boosted_stumps(drawn.where("train"), drawn.where("not train"), 7).collect():
            assert got[k, r.node] == pytest.approx(r.prob)
    one = evaluate.resampled_boost(seeds, 3, 12, 9, 20, 7)
    other = evaluate.resampled(seeds, 3, 12, 9, 20, lambda a, b: models.boosted_stumps(a, b, 7))
    assert np.allclose(*[sorted(map(tuple, curve.collect())) for curve in (one, other)])


def test_a_forest_grown_by_lots(spark, monkeypatch):
    """As many trees as asked for, few at a time; the chances are the mean over all of them, one for each row."""
    rows = models.gaussian_mixture(spark, 300, 3, seed=2).cache()
    train, test = rows.where("node < 200"), rows.where("node >= 200")
    asked = test.unionByName(test.limit(1))
    grown, made = [], models.RandomForestClassifier

    def forest(**options):
        grown.append((options["numTrees"], options["seed"]))
        return made(**options)

    monkeypatch.setattr(models, "RandomForestClassifier", forest)
    monkeypatch.setattr(models, "GROWN", 900)  # four trees at a time
    got = models.random_forest(train, asked, 10, 5)
    by = {r.node: r.prob for r in got.collect()}
    assert grown == [(4, 5), (4, 6), (2, 7)] and got.count() == asked.count() == 101
    monkeypatch.undo()
    lots = [{r.node: r.prob for r in models.random_forest(train, test, many, s).collect()} for many, s in grown]
    assert all(by[n] == pytest.approx((4 * lots[0][n] + 4 * lots[1][n] + 2 * lots[2][n]) / 10) for n in by)
