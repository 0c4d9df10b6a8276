"""The hand-worked four-vertex graph, and operators against dense matrices."""

import math

import numpy as np
import pytest
from graphnom.functions import measures as M
from graphnom.operators import algebra, blocks, cooccur, graph, neighbours, spectral
from graphnom.operators.attributes import Attributes, check_seeds
from graphnom.plans.embeddings import content_operator, node_operator, variant
from graphnom.plans.tables import run_folder
from graphnom.sources.readers import listing
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tiny(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3), (3, 3)], "src long, dst long")
    rows = spark.createDataFrame([(0, "t", "a"), (0, "t", "b"), (1, "t", "a"), (3, "t", "b")], "node long, attributeType string, attributeVal string")
    return edges, rows, rows.select("node", F.col("attributeVal").alias("val"))


def dense(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.i, r.j] += r.v
    return out


def test_adjacency_and_degrees(tiny):
    edges, _, _ = tiny
    a = dense(graph.adjacency(edges), 4)
    assert graph.vertex_count(edges) == 4
    assert a.tolist() == [[0, 1, 1, 0], [1, 0, 1, 0], [1, 1, 0, 1], [0, 0, 1, 1]]
    assert sorted(np.linalg.eigvalsh(a).round(6)) == [-1.302776, -1, 1, 2.302776]
    d = {r.i: r.d for r in graph.degrees(graph.adjacency(edges)).collect()}
    assert d == {0: 2, 1: 2, 2: 3, 3: 2} and graph.mean_degree(graph.adjacency(edges), 4) == 2.25
    twice = edges.unionByName(edges.selectExpr("dst as src", "src as dst").where("src <> dst"))
    assert dense(graph.adjacency(twice), 4)[0, 1] == 2


def test_pair_counts_and_similarity(tiny):
    edges, _, values = tiny
    nodes = graph.vertices(edges)
    assert [r.val for r in cooccur.vocabulary(values, nodes).orderBy("idx").collect()] == ["*???*_2", "a", "b"]
    counts = cooccur.count_pairs(edges, values, nodes)
    assert {(r.a, r.b): r.c for r in counts.pairs.collect()} == {("a", "a"): 1, ("a", "b"): 1, ("b", "b"): 1, ("*???*_2", "a"): 2, ("*???*_2", "b"): 2}
    assert counts.total == 7 and counts.values == 3
    assert {r.val: r.m for r in counts.marginals.collect()} == {"*???*_2": 4, "a": 4, "b": 4}
    s = {(r.a, r.b): r.s for r in cooccur.measured(counts, "NPMI1s").collect()}
    assert s["a", "b"] == pytest.approx(0.287586, abs=1e-6) and s["*???*_2", "a"] == pytest.approx(0.446705, abs=1e-6)


def test_node_similarity(spark, tiny):
    edges, _, values = tiny
    nodes = graph.vertices(edges)
    op = node_operator(edges, values, nodes, "NPMI1s", 0.0)
    d = op.todense(spark)
    want = np.full((4, 4), 0.287586)
    want[2, :] = want[:, 2] = 0.446705
    want[2, 2] = 0
    assert np.allclose(d, want, atol=1e-6)
    assert np.allclose(sorted(np.linalg.eigvalsh(d)), [-0.454468, 0, 0, 1.317225], atol=1e-6)
    assert op.get(spark, 0, 2) == pytest.approx(0.446705, abs=1e-6)
    for kind in ("adj", "adj+diag", "normlap", "regnormlap"):
        deg = d.sum(axis=1)
        tau = deg.mean() if kind == "regnormlap" else 0
        full = {"adj": d, "adj+diag": d + np.diag(deg) / 4}.get(kind, np.eye(4) - d / np.sqrt(np.outer(deg + tau, deg + tau)))
        assert np.allclose(content_operator(op, kind, spark).todense(spark), full)
    smooth = node_operator(edges, values, nodes, "PMIs", 0.5).todense(spark)
    c, m, v, e = {(0, 0): 0, (0, 1): 2, (0, 2): 2, (1, 1): 1, (1, 2): 1, (2, 2): 1}, [4, 4, 4], 3, 7
    sim = np.array([[math.log(c[min(i, j), max(i, j)] + 0.5) + math.log(e + 0.5 * 6) - math.log(m[i] + 1.5) - math.log(m[j] + 1.5) for j in range(3)] for i in range(3)])
    col = np.array([[0, 0, 1, 0], [0.5, 1, 0, 0], [0.5, 0, 0, 1]])
    assert np.allclose(smooth, col.T @ sim @ col)


def test_operator_algebra_against_dense(spark):
    rng = np.random.default_rng(1)
    n = 5
    a, b = rng.random((n, n)).round(2), rng.random((n, n)).round(2)
    a, b = a + a.T, b + b.T
    table = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i long, j long, v double")
    weights = lambda w: spark.createDataFrame([(k, float(x)) for k, x in enumerate(w)], "id long, w double")
    oa, ob = algebra.sparse((n, n), table(a), True), algebra.sparse((n, n), table(b), True)
    u, v = rng.random(n), rng.random(n)
    one = np.ones(n)
    cases = [
        (oa + ob, a + b), (2.5 * oa - ob, 2.5 * a - b), (oa * ob, a @ b), ((oa * ob).transpose(), b @ a), (oa + 3.0, a + 3), (-oa, -a),
        (algebra.constant_diagonal(n, 2.0), 2 * np.eye(n)), (algebra.diagonal(n, weights(u).withColumnRenamed("w", "d")), np.diag(u)),
        (algebra.rank_one((n, n), weights(u), weights(v)), np.outer(u, v)), (algebra.rank_one((n, n), weights(u), weights(v)).transpose(), np.outer(v, u)),
        (algebra.replicated_column(n, weights(u)), np.outer(u, one)), (algebra.replicated_row(n, weights(u)), np.outer(one, u)),
        (algebra.pmi(n, table(a), 1.5, weights(u)), a + 1.5 - np.outer(u, one) - np.outer(one, u)),
        (algebra.blocks([[oa, ob], [ob, oa]]), np.block([[a, b], [b, a]])), (algebra.blocks([[oa, ob], [ob, oa]]).transpose(), np.block([[a, b], [b, a]]).T),
        (algebra.joint_blocks([oa, ob]), np.block([[a, (a + b) / 2], [(a + b) / 2, b]])), (algebra.joint_blocks([oa, ob], 2.0), np.block([[a, (a + b) / 2 + 2 * np.eye(n)], [(a + b) / 2 + 2 * np.eye(n), b]])),
        (oa.row_stochastic(spark), a / a.sum(axis=1, keepdims=True)), (oa.column_stochastic(spark), a / a.sum(axis=0)),
        (algebra.laplacian(n, table(a)), np.diag(a.sum(axis=1)) - a), (algebra.diagonal_added(n, table(a)), a + np.diag(a.sum(axis=1)) / n),
        (algebra.normalized_laplacian(n, table(a)), np.eye(n) - a / np.sqrt(np.outer(a.sum(axis=1), a.sum(axis=1)))),
    ]
    for op, want in cases:
        assert np.allclose(op.todense(spark), want)
    with pytest.raises(ValueError):
        algebra.blocks([[oa, algebra.ones(3)]])
    with pytest.raises(ValueError):
        algebra.collapse(spark.createDataFrame([(0, 0), (1, 9)], "node long, image long"), 3, 2)


def test_elbows():
    assert spectral.elbows([20, 5, 4.8, 4.5, 1, 0.9, 0.8]) == [0]
    assert spectral.elbows([10, 9, 8, 2, 1.8, 1.5, 1.4, 1.2]) == [2]
    assert spectral.elbows([10, 1, 1, 1, 1]) == [0]
    two = spectral.elbows([10, 9, 8, 2, 1.8, 1.5, 1.4, 1.2], 2)
    assert two[0] == 2 and len(two) == 2 and two[1] > 2
    assert spectral.kept_columns(np.array([5.0, 4, 1]), 0) == 3
    with pytest.raises(ValueError):
        spectral.elbows([1, 2])


def test_eigenpairs_of_either_sign(spark):
    """A bipartite graph has pairs of eigenvalues of either sign, which must come apart."""
    edges = spark.createDataFrame([(i, 6 + j) for i in range(6) for j in range(5) if (i * j) % 3 != 1], "src long, dst long")
    n = graph.vertex_count(edges)
    a = dense(graph.adjacency(edges), n)
    want = sorted(np.linalg.eigvalsh(a), key=lambda x: (-abs(x), x))
    values, vectors = spectral.eigenpairs(variant("adj", n, graph.adjacency(edges).cache()), 4, spark, tol=1e-10)
    assert np.allclose(np.abs(values), np.abs(want[:4]), atol=1e-9)
    assert np.abs(a @ block_of(vectors, n, 4) - block_of(vectors, n, 4) * values).max() < 1e-8


def block_of(vectors, n, k):
    x = np.zeros((n, k))
    for r in vectors.collect():
        x[r.id, r.col] = r.x
    return x


def matrix_table(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(r), int(c), float(a[r, c])) for r, c in zip(i, j, strict=True)], "i long, j long, v double")


def test_restarts_reach_the_pairs_of_a_power_law_spectrum(spark, monkeypatch):
    """Small tiles and blocks, so that a basis is restarted, several blocks and slices meet, and blocks are not broadcast."""
    monkeypatch.setattr(blocks, "TILE", 64)
    monkeypatch.setattr(blocks, "SLICE", 50)
    monkeypatch.setattr(blocks, "SENT", 1000)
    monkeypatch.setattr(spectral, "NARROW", 2)
    rng = np.random.default_rng(2)
    n, k = 150, 5
    turn, _ = np.linalg.qr(rng.normal(size=(n, n)))
    spectrum = np.arange(1, n + 1) ** -0.8 * np.where(np.arange(n) % 3 == 1, -1, 1)
    a = turn @ np.diag(spectrum) @ turn.T
    a = np.where(np.abs(a) < 1e-13, 0, (a + a.T) / 2)
    values, vectors = spectral.eigenpairs(algebra.sparse((n, n), matrix_table(spark, a), True), k, spark, tol=1e-7)
    x = block_of(vectors, n, k)
    assert np.allclose(values, np.linalg.eigvalsh(a)[np.argsort(-np.abs(np.linalg.eigvalsh(a)))][:k], atol=1e-7)
    assert np.abs(a @ x - x * values).max() < 1e-6 and np.abs(x.T @ x - np.eye(k)).max() < 1e-8
    assert (x[np.abs(x).argmax(axis=0), np.arange(k)] > 0).all()


def test_pairs_where_the_krylov_space_ends_early(spark):
    """More equal values than a block is wide, a graph in two parts, an operator of low rank."""
    for a in (np.eye(40) * 2.0 + np.diag(np.arange(40) >= 25) * 1.0, np.kron(np.eye(2), np.ones((9, 9)) - np.eye(9)), np.outer(np.arange(30), np.arange(30)) * 1.0):
        n = len(a)
        values, vectors = spectral.eigenpairs(algebra.sparse((n, n), matrix_table(spark, a), True), 18 if n == 40 else 4, spark, tol=1e-9)
        want = np.linalg.eigvalsh(a)
        assert np.allclose(np.abs(values), np.sort(np.abs(want))[::-1][: len(values)], atol=1e-6)
        x = block_of(vectors, n, len(values))
        assert np.abs(a @ x - x * values).max() < 1e-6


def test_a_solver_that_does_not_settle_raises(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 300)) * (rng.random((300, 300)) < 0.1)
    with pytest.raises(ArithmeticError):
        spectral.eigenpairs(algebra.sparse((300, 300), matrix_table(spark, a + a.T), True), 5, spark, tol=1e-15, most=3)


def test_rows_of_a_product_do_not_depend_on_the_width(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TILE", 64)
    monkeypatch.setattr(blocks, "SLICE", 40)
    rng = np.random.default_rng(4)
    a = (rng.random((200, 200)) < 0.05) * rng.random((200, 200))
    a[:, 7] = 1.0  # a column that holds many entries is cut into slices
    tiles = blocks.tiled(matrix_table(spark, a))
    counts = {len(r.i) for r in tiles.entries.collect()}
    assert max(counts) < 100 and tiles.slices.where("bj = 0").first().slices > 5
    parts = {w: blocks.multiplied(tiles, blocks.dealt(spark, 200, w, 1), w, 200).count() for w in (1, 5, 40)}
    assert len(set(parts.values())) == 1
    x = block_of(blocks.unpack(blocks.dealt(spark, 200, 5, 1), 5), 200, 5)
    for sent in (1 << 25, 10):
        monkeypatch.setattr(blocks, "SENT", sent)
        y = blocks.summed(blocks.multiplied(tiles, blocks.dealt(spark, 200, 5, 1), 5, 200), 5, 200)
        assert np.allclose(block_of(blocks.unpack(y, 5), 200, 5), a @ x)
    rows = {r.id: r.x for r in blocks.as_rows(blocks.dealt(spark, 200, 5, 1), 5, 200).collect()}
    assert sorted(rows) == list(range(200)) and np.allclose([rows[k] for k in range(200)], x)


def test_small_operators_show_their_entries(spark):
    op = algebra.diagonal(2, spark.createDataFrame([(0, 2.0), (1, 5.0)], "id long, d double"))
    assert repr(op) == "Operator(2, 2)\n[[2. 0.]\n [0. 5.]]"
    assert repr(algebra.constant_diagonal(2000, 1.0)) == "Operator(2000, 2000)"


def test_attributes(spark, tiny):
    _, rows, _ = tiny
    at = Attributes(rows.unionByName(rows.limit(1)))
    assert {r.val: r.freq for r in at.frequencies().collect()} == {"a": 3, "b": 2}  # raw rows
    assert [r.ind for r in at.indicator(spark.range(4).withColumnRenamed("id", "node"), "t", "a").orderBy("node").collect()] == [1, 1, None, 0]
    assert [(r["rank"], r.val, round(r.cumulative_pct, 3)) for r in at.ranked(5).orderBy("rank").collect()] == [(0, "a", 60.0), (1, "b", 100.0)]
    with pytest.raises(ValueError):
        check_seeds(at.indicator(spark.range(4).withColumnRenamed("id", "node"), "t", "a"))


def test_safe_division(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in rows.select(M.safe_divide(F.col("a"), F.col("b"))).collect()] == [0, 0, math.inf, -math.inf, 1.5]
    one = spark.createDataFrame([(1.0, 1.0, 1.0), (0.0, 0.5, 0.5)], "ab double, a double, b double")
    assert [r[0] for r in one.select(M.npmi1_s(F.col("ab"), F.col("a"), F.col("b"))).collect()] == [0, 0]


def test_report_rounds_a_share_as_it_is_held(spark):
    """3197 of 3200 are 99.90625 %, half way between two lines of four digits: to even, as C's printf has it."""
    rows = spark.range(3200).select("id", F.lit("t").alias("attributeType"), F.when(F.col("id") < 3197, "a").otherwise("b").alias("attributeVal"))
    assert [r.value for r in Attributes(rows).report(2).orderBy("line").collect()] == ["=== t ===", "2 values, 3200 instances", "0\ta\t3197\t99.9062", "1\tb\t3\t100.0000"]


def random_edges(spark, n, many, seed):
    """Edges with copies, turned copies and loops; and their dense adjacency."""
    rng = np.random.default_rng(seed)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, n, (many, 2))] + [(3, 3), (3, 3), (n - 1, 0), (0, n - 1)]
    pairs += [(7, k) for k in range(n)]  # one end of many edges
    a = np.zeros((n, n))
    for i, j in pairs:
        a[i, j] += 1
        a[j, i] += i != j
    return spark.createDataFrame(pairs, "src long, dst long").repartition(5), a


@pytest.fixture
def small_rows(monkeypatch):
    """Blocks of 64 rows, groups of 128 columns, many packs."""
    monkeypatch.setattr(blocks, "TILE", 64)
    for name, value in (("GROUP", 128), ("PACKED", 100), ("SORTED", 150)):
        monkeypatch.setattr(neighbours, name, value)


def test_a_product_by_rows(spark, monkeypatch, small_rows):
    """Vectors are sent by pieces: some columns over a group of ids."""
    monkeypatch.setattr(neighbours, "SENT", 2500)
    edges, a = random_edges(spark, 150, 600, 5)
    op = algebra.adjacency(edges)
    assert op.shape == (150, 150)
    x = block_of(blocks.unpack(blocks.dealt(spark, 150, 3, 1), 3), 150, 3)
    assert np.allclose(block_of(blocks.unpack(op.product(blocks.dealt(spark, 150, 3, 1), 3), 3), 150, 3), a @ x)


def test_pairs_of_an_adjacency_in_one_task(spark, small_rows):
    edges, a = random_edges(spark, 300, 1500, 5)
    op = algebra.adjacency(edges)
    values, vectors = spectral.eigenpairs(op, 4, spark, tol=1e-8)
    x, want = block_of(vectors, 300, 4), np.linalg.eigvalsh(a)
    assert np.allclose(values, want[np.argsort(-np.abs(want))][:4], atol=1e-6)
    assert np.abs(a @ x - x * values).max() < 1e-5 and np.abs(x.T @ x - np.eye(4)).max() < 1e-8
    with pytest.raises(ArithmeticError):
        spectral.eigenpairs(op, 4, spark, tol=1e-15, most=3)


@pytest.mark.parametrize("held", [1 << 28, 0])
def test_of_equal_values_the_vector_of_powers(spark, monkeypatch, held):
    """The leading pair in one task and step by step, of a graph twice over: powers times the ones tend to this vector."""
    monkeypatch.setattr(spectral, "HELD", held)
    edges, a = random_edges(spark, 100, 900, 7)
    twice = edges.unionByName(edges.select(F.col("src") + 100, F.col("dst") + 100).toDF("src", "dst"))
    values, vectors = spectral.eigenpairs(algebra.adjacency(twice), 1, spark, tol=1e-6, ones=True)
    x = block_of(vectors, 200, 1)[:, 0]
    assert values[0] == pytest.approx(np.linalg.eigvalsh(a)[-1]) and np.allclose(x[:100], x[100:], atol=1e-7) and (x > 0).all()


def test_the_solver_removes_what_a_step_leaves(spark, monkeypatch):
    monkeypatch.setattr(spectral, "NARROW", 2)
    edges, a = random_edges(spark, 200, 900, 6)
    matrix = graph.adjacency(edges).cache()
    sizes = lambda: set(listing(spark, run_folder(spark)))
    before = sizes()
    values, vectors = spectral.eigenpairs(algebra.sparse((200, 200), matrix, True), 1, spark, tol=1e-2)
    left = sizes() - before
    assert len(left) <= 4  # tiles, their slices, the vectors
    x = block_of(vectors, 200, 1)
    assert np.linalg.norm(a @ x - x * values) <= 0.02 * values[0]


@pytest.mark.parametrize("a", [np.eye(40) * 2.0 + np.diag(np.arange(40) >= 25) * 1.0, np.kron(np.eye(2), np.ones((9, 9)) - np.eye(9)), np.outer(np.arange(30), np.arange(30)) * 1.0, np.ones((1, 1))])
def test_pairs_held_in_a_task_where_the_krylov_space_ends_early(a):
    n = len(a)
    k = min(18 if n == 40 else 4, max(n - 1, 1))
    values, x, _, off = spectral.held_pairs(lambda v: a @ v, n, k, min(8, n), k + min(8, n), k + 160, 1e-9, 400, lambda m: np.random.default_rng(m).uniform(-1, 1, (n, min(8, n))))
    want = np.sort(np.abs(np.linalg.eigvalsh(a)))[::-1]
    assert off == 0 and len(values) == k and np.allclose(np.abs(values), want[:k], atol=1e-6)
    assert np.abs(a @ x - x * values).max() < 1e-6 and np.abs(x.T @ x - np.eye(k)).max() < 1e-8
