"""From a graph and its attributes to a ranked list of nodes that may hold a value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphnom.config import Config
from graphnom.operators import evaluate, features, graph, models, spectral
from graphnom.operators.attributes import Attributes, check_seeds
from graphnom.sources import writers

from .embeddings import embed
from .tables import materialise


def width_of(df: DataFrame) -> int:
    row = df.select(F.size("features")).first()
    return row[0] if row else 0


def scaled(nodes: DataFrame, blocks: list[DataFrame], config: Config) -> DataFrame:
    """node, features: blocks side by side, z-scored, and their principal components if asked."""
    if not blocks:
        raise ValueError("no predictors")
    full = materialise(features.stacked(nodes, blocks))
    width = width_of(full)
    full = features.zscored(full, width)
    if config.use_pca:
        variances, full = features.pca(full, width, config.max_eig_pca or width, config.whiten)
        keep = spectral.kept_columns(variances, config.which_elbow_pca) if len(variances) > 2 else len(variances)
        full = full.withColumn("features", F.slice("features", 1, max(keep, 1)))
    return full


def predictors(spark: SparkSession, edges: DataFrame, attributes: DataFrame, config: Config, folder: str | None = None) -> DataFrame:
    """node, features for every vertex: embeddings (on the sphere where asked) and numeric attributes with missing
    ones filled, scaled."""
    nodes = graph.vertices(edges)
    embeddings = embed(spark, edges, attributes, config, folder)
    blocks = []
    if config.use_context:
        own = embeddings[""].features
        blocks.append(features.on_sphere(own) if config.sphere_context else own)
    for kind in config.categorical:
        own = embeddings[kind].features
        blocks.append(features.on_sphere(own) if config.sphere_content else own)
    if config.numeric:
        wide = features.impute(features.numeric_pivot(attributes, config.numeric, nodes), config.numeric, config.imputation)
        blocks.append(wide.select("node", F.array(*config.numeric).alias("features")))
    return scaled(nodes, blocks, config)


def classifier(config: Config, name: str | None = None):
    """(train, test) to (node, prob), by the classifier of that name or the config's."""
    name = name or config.classifier
    options = {"randfor": {"trees": config.num_trees, "seed": config.rng_seed}, "boost": {"rounds": config.num_trees, "seed": config.rng_seed}, "kde": {"gridsize": config.kde_grid, "dynamic_range": config.kde_range, "cv": config.kde_folds}}
    return lambda train, test: models.classify(name, train, test, **options.get(name, {}))


def cross_validated(seeds: DataFrame, config: Config) -> DataFrame:
    """node, ind, prob of the held-out seeds, each under a model of all others; empty if cv_max is 0. Naive Bayes and
    density estimates leave a row out in closed form, bandwidths are sought once, on all seeds; the models of logistic
    regression are solved together."""
    if config.cv_max == 0:
        return seeds.sparkSession.createDataFrame([], "node long, ind double, prob double")
    held = materialise(evaluate.interleaved(seeds, config.cv_max, config.rng_seed))
    if config.classifier == "naive_bayes":
        return evaluate.leave_one_out_bayes(seeds, held)
    if config.classifier == "logreg":
        return models.left_out_logreg(seeds, held)
    if config.classifier == "kde":
        model = models.TwoClassKDE().fit_with_optimal_bandwidth(seeds, config.kde_grid, config.kde_range, config.kde_folds)
        asked = seeds.join(held.select("node"), "node", "left_semi")
        return model.predict_proba(asked, exclude_self=True).join(held, "node").select("node", "ind", F.col("p1").alias("prob"))
    return evaluate.leave_one_out(seeds, held, classifier(config), config.n_jobs)


def decorated(ranked: DataFrame, attributes: DataFrame, config: Config, also: tuple[str, ...] = ()) -> DataFrame:
    """Ranked nodes with their values: sorted sets of categorical types (empty if none), numbers or null."""
    out = ranked
    for kind in (*also, *config.categorical):
        sets = attributes.where(F.col("attributeType") == kind).groupBy("node").agg(F.array_sort(F.collect_set("attributeVal")).alias(kind))
        out = out.join(sets, "node", "left").withColumn(kind, F.coalesce(kind, F.array().cast("array<string>")))
    if config.numeric:
        out = out.join(features.numeric_pivot(attributes, config.numeric), "node", "left")
    return out


def nominate(scores: DataFrame, most: int) -> DataFrame:
    """The likeliest nodes: node, prob."""
    return scores.orderBy(F.desc("prob"), "node").limit(most)


def run(spark: SparkSession, edges: DataFrame, attributes: DataFrame, config: Config, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cross-validation curve, nominations); both are written if a folder is given."""
    rows = materialise(predictors(spark, edges, attributes, config, folder))
    labels = Attributes(attributes).indicator(graph.vertices(edges), config.nomination_type, config.nomination_value)
    check_seeds(labels)
    known = materialise(rows.join(labels, "node"))
    seeds, unknown = known.where("ind is not null"), known.where("ind is null")
    fit = classifier(config)
    tested = materialise(cross_validated(seeds, config))
    curve = evaluate.cumulative_precision(tested)
    top = nominate(fit(seeds, unknown), config.nominate_max)
    if folder:
        stem = f"{folder}/{config.nomination_type}_{config.nomination_value}".replace(" ", "_")
        order = [F.desc("prob"), "node"]
        if config.cv_max:
            cv = decorated(tested.select("node", "prob", "ind"), attributes, config, (config.nomination_type,))
            writers.save_ranked(cv.orderBy(*order), f"{stem}_cv_nomination.txt")
        writers.save_ranked(decorated(top, attributes, config).orderBy(*order), f"{stem}_nomination.out")
    return curve, top


#: What the harness varies.
EMBEDDING_CHOICES = ("context", "NPMIs", "both")
HARNESS_CLASSIFIERS = ("logreg", "randfor", "boost", "kde")


def choice_of_features(spark: SparkSession, edges: DataFrame, attributes: DataFrame, config: Config, choice: str, sphere_content: bool, folder: str | None = None) -> DataFrame:
    """Scaled features of the context embedding, the content embeddings, or both."""
    if choice not in EMBEDDING_CHOICES:
        raise ValueError(f"no embedding choice {choice!r}")
    made = embed(spark, edges, attributes, config.with_(use_context=choice != "NPMIs"), folder)
    blocks = []
    if choice != "NPMIs":
        blocks.append(features.on_sphere(made[""].features) if config.sphere_context else made[""].features)
    if choice != "context":
        blocks += [features.on_sphere(made[k].features) if sphere_content else made[k].features for k in config.categorical]
    return scaled(graph.vertices(edges), blocks, config)


def facet_curves(seeds: dict[tuple[str, bool], DataFrame], config: Config, samples: int, positives: int, negatives: int, top: int, classifiers: tuple[str, ...] = HARNESS_CLASSIFIERS) -> DataFrame:
    """embedding_info, sphere_content, classifier, rank, mean_prec, stderr_prec, low, high: one curve for each choice
    of features (node, features, ind) and each classifier."""
    out = None
    for (choice, sphere), rows in seeds.items():
        for name in classifiers:
            if name == "naive_bayes":
                own = evaluate.resampled_bayes(rows, samples, positives, negatives, top)
            elif name == "boost":
                own = evaluate.resampled_boost(rows, samples, positives, negatives, top, config.num_trees)
            else:
                own = evaluate.resampled(rows, samples, positives, negatives, top, classifier(config, name), config.n_jobs)
            own = own.select(F.lit(choice).alias("embedding_info"), F.lit(sphere).alias("sphere_content"), F.lit(name).alias("classifier"), "rank", "mean_prec", "stderr_prec", "low", "high")
            out = own if out is None else out.unionByName(own)
    return out


def harness(spark: SparkSession, edges: DataFrame, attributes: DataFrame, config: Config, positives: int = 50, negatives: int = 50, samples: int = 50, top: int = 1000, choices: tuple[str, ...] = EMBEDDING_CHOICES, spheres: tuple[bool, ...] = (True,), classifiers: tuple[str, ...] = HARNESS_CLASSIFIERS, folder: str | None = None) -> DataFrame:
    """The Monte-Carlo harness of one attribute value; its curves are saved as CSV if a folder is given."""
    labels = Attributes(attributes).indicator(graph.vertices(edges), config.nomination_type, config.nomination_value)
    check_seeds(labels)
    known = labels.where("ind is not null")
    seeds = {}
    for choice in choices:
        for sphere in spheres:
            rows = choice_of_features(spark, edges, attributes, config, choice, sphere, folder)
            seeds[choice, sphere] = materialise(rows.join(known, "node"))
    curves = materialise(facet_curves(seeds, config, samples, positives, negatives, top, classifiers))
    if folder:
        writers.save_precision(curves, precision_path(folder, config, positives, negatives))
    return curves


def precision_path(folder: str, config: Config, positives: int, negatives: int) -> str:
    return f"{folder}/{config.nomination_type}_{config.nomination_value}_+{positives}_-{negatives}.csv".replace(" ", "_")
