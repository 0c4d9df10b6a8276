"""Context and content embeddings of an attributed graph, with a cache under exact keys."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphnom.config import Config
from graphnom.functions.text import token
from graphnom.operators import cooccur, graph, algebra, spectral
from graphnom.operators.attributes import Attributes
from graphnom.sources.writers import EmbeddingCache, embedding_key, save_eigenvalues, save_report

from .tables import materialise


@dataclass
class Embedding:
    features: DataFrame
    eigenvalues: np.ndarray | None  # None if it came from the cache
    key: str


def variant(kind: str, n: int, matrix: DataFrame) -> algebra.Operator:
    """The operator that an embedding kind takes of an adjacency matrix."""
    if kind == "adj":
        return algebra.sparse((n, n), matrix, True)
    if kind == "adj+diag":
        return algebra.diagonal_added(n, matrix)
    if kind == "normlap":
        return algebra.normalized_laplacian(n, matrix)
    if kind == "regnormlap":
        return algebra.regularized_laplacian(n, matrix)
    raise ValueError(f"no embedding {kind!r}")


def node_operator(edges: DataFrame, values: DataFrame, nodes: DataFrame, sim: str, delta: float) -> algebra.Operator:
    """Node similarity as the mean similarity of the nodes' values. values: node, val."""
    if (delta > 0) != (sim == "PMIs"):
        raise ValueError("smoothing (delta) goes with PMIs, and only with it")
    words = cooccur.vocabulary(values, nodes)
    counts = cooccur.count_pairs(edges, values, nodes)
    n, m = nodes.count(), counts.values
    index = lambda side: words.select(F.col("val").alias(side), F.col("idx").alias(f"{side}_idx"))

    def indexed(matrix: DataFrame) -> DataFrame:
        return matrix.join(index("i"), "i").join(index("j"), "j").select(F.col("i_idx").alias("i"), F.col("j_idx").alias("j"), "v")

    if sim == "PMIs":
        sparse, constant, u = cooccur.smoothed_pmi_parts(counts, delta)
        floor = float(np.log(delta * m))
        full = words.join(u, "val", "left").select(F.col("idx").alias("id"), F.coalesce("u", F.lit(floor)).alias("w"))
        similarity = algebra.pmi(m, materialise(indexed(sparse)), constant, materialise(full))
    else:
        similarity = algebra.sparse((m, m), materialise(indexed(cooccur.similarity_matrix(counts, sim))), True)
    named = nodes.join(values, "node", "left").select("node", F.coalesce("val", token(F.col("node"))).alias("val"))
    mapping = materialise(named.join(words, "val").select("node", F.col("idx").alias("image")))
    return algebra.uncollapsed(algebra.collapse(mapping, m, n), similarity)


def content_operator(op: algebra.Operator, kind: str, spark: SparkSession) -> algebra.Operator:
    """The variant of a matrix-free operator: degrees are its product with ones."""
    n = op.shape[0]
    if kind == "adj":
        return op
    ones = spark.range(n).select("id", F.lit(0).cast("long").alias("col"), F.lit(1.0).alias("x"))
    d = materialise(op.apply(ones, 1).select("id", F.col("x").alias("d")))
    if kind == "adj+diag":
        return op + algebra.diagonal(n, d.withColumn("d", F.col("d") / n))
    shift = (d.agg(F.sum("d")).first()[0] or 0.0) / n if kind == "regnormlap" else 0.0
    root = algebra.diagonal(n, d.where(F.col("d") + shift > 0).select("id", (1 / F.sqrt(F.col("d") + shift)).alias("d")))
    return algebra.constant_diagonal(n, 1.0) - root * op * root


def context(spark: SparkSession, edges: DataFrame, config: Config, cache: EmbeddingCache | None = None) -> Embedding:
    key = embedding_key(config.embedding, config.max_eig)
    if cache is not None and config.load_embeddings and (found := cache.get(key)) is not None:
        return Embedding(found, None, key)
    n = graph.vertex_count(edges)
    op = variant(config.embedding, n, materialise(graph.adjacency(edges)))
    values, features = spectral.embedding(op, spark, config.embedding, min(config.max_eig, max(n - 1, 1)), config.which_elbow, config.rng_seed)
    return Embedding(cache.put(key, features) if cache is not None else features, values, key)


def content(spark: SparkSession, edges: DataFrame, attributes: DataFrame, kind: str, config: Config, cache: EmbeddingCache | None = None) -> Embedding:
    key = embedding_key(config.embedding, config.max_eig, kind, config.sim, config.delta)
    if cache is not None and config.load_embeddings and (found := cache.get(key)) is not None:
        return Embedding(found, None, key)
    nodes = graph.vertices(edges)
    values = attributes.where(F.col("attributeType") == kind).select("node", F.col("attributeVal").alias("val")).distinct().join(nodes, "node", "left_semi")
    op = content_operator(node_operator(edges, values, nodes, config.sim, config.delta), config.embedding, spark)
    found, features = spectral.embedding(op, spark, config.embedding, config.max_eig, config.which_elbow, config.rng_seed)
    return Embedding(cache.put(key, features) if cache is not None else features, found, key)


def embed(spark: SparkSession, edges: DataFrame, attributes: DataFrame, config: Config, folder: str | None = None) -> dict[str, Embedding]:
    """The context embedding ("", if asked for) and one for each embedded type. With a folder: embeddings are kept
    there, and eigenvalues and the attribute report are written."""
    cache = EmbeddingCache(spark, folder) if folder else None
    out: dict[str, Embedding] = {}
    if config.use_context:
        out[""] = context(spark, edges, config, cache)
    if folder:
        save_report(Attributes(attributes).report(config.rank_thresh), f"{folder}/attr_report.txt")
    for kind in config.embedded:
        out[kind] = content(spark, edges, attributes, kind, config, cache)
    if folder and config.save_info:
        for e in out.values():
            if e.eigenvalues is not None:
                save_eigenvalues(spark, list(e.eigenvalues), f"{folder}/{e.key}_eigvals.csv")
    return out
