"""Registered queries of the graph operators, each with SQL for a second engine where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphnom.config import Config
from graphnom.functions import measures as M
from graphnom.operators import cooccur, evaluate, features, graph, algebra, models, spectral
from graphnom.operators.attributes import Attributes, log_ranks, seed_counts
from graphnom.sources import readers, writers

from .fixtures import Fixtures
from .nomination import nominate
from .tables import materialise, run_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NODES = "nodes AS (SELECT p_partkey AS node FROM part)"
EDGES = "edges AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"
ATTRS = """attrs AS (
  SELECT p_partkey AS node, 'brand' AS type, p_brand AS val FROM part WHERE p_partkey % 5 <> 0
  UNION ALL SELECT p_partkey, 'word', unnest(string_split(p_name, ' ')) FROM part WHERE p_partkey % 7 <> 0
  UNION ALL SELECT p_partkey, 'ptype', p_type FROM part WHERE p_partkey % 3 <> 0
  UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 11 <> 0
  UNION ALL SELECT p_partkey, 'retailprice', CAST(p_retailprice AS VARCHAR) FROM part WHERE p_partkey % 11 <> 0)"""
MATRIX = "adj AS (SELECT i, j, CAST(count(*) AS DOUBLE) AS v FROM (SELECT src AS i, dst AS j FROM edges UNION ALL SELECT dst, src FROM edges WHERE src <> dst) GROUP BY i, j)"
DEGREE = "deg AS (SELECT i, sum(v) AS d FROM adj GROUP BY i), n AS (SELECT max(greatest(src, dst)) + 1 AS n FROM edges), verts AS (SELECT unnest(range(0, (SELECT n FROM n))) AS node)"
GRAPH = f"{EDGES}, {MATRIX}, {DEGREE}"


def pairs_sql(kind: str) -> str:
    """Values, their pair counts, marginals and totals of one type."""
    return f"""{NODES}, {EDGES}, {ATTRS},
  vals AS (SELECT DISTINCT node, val FROM attrs WHERE type = '{kind}'),
  ends AS (SELECT coalesce(x.val, '*???*_' || e.src) AS u, coalesce(y.val, '*???*_' || e.dst) AS v
           FROM edges e LEFT JOIN vals x ON e.src = x.node LEFT JOIN vals y ON e.dst = y.node),
  pairs AS (SELECT least(u, v) AS a, greatest(u, v) AS b, CAST(count(*) AS BIGINT) AS c FROM ends GROUP BY 1, 2),
  marg AS (SELECT val, CAST(sum(c) AS BIGINT) AS m FROM (SELECT a AS val, c FROM pairs UNION ALL SELECT b, c FROM pairs WHERE a <> b) GROUP BY val),
  vocab AS (SELECT DISTINCT coalesce(vals.val, '*???*_' || nodes.node) AS val FROM nodes LEFT JOIN vals ON nodes.node = vals.node),
  tot AS (SELECT CAST(sum(c) AS DOUBLE) AS t, (SELECT CAST(count(*) AS DOUBLE) FROM vocab) AS k FROM pairs)"""


def probs_sql(kind: str, delta: float = 0.0) -> str:
    return f"""{pairs_sql(kind)},
  p AS (SELECT a, b, c, (x.m + {delta} * k) / (t + {delta} * k * k) AS pa, (y.m + {delta} * k) / (t + {delta} * k * k) AS pb,
               (c + {delta}) / (t + {delta} * k * (k + 1) / 2) AS pab
        FROM pairs JOIN marg x ON a = x.val JOIN marg y ON b = y.val, tot)"""


FEATURES = "feats AS (SELECT vec_id AS node, embedding, CASE WHEN vec_id % 4 <> 0 THEN CASE WHEN label = 2 THEN 1.0 ELSE 0.0 END END AS ind FROM embeddings)"
LONG = f"{FEATURES}, long AS (SELECT node, ind, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, 64)) AS pos FROM feats)"


def query(sql: str | None = None):
    def add(function: Callable[[Fixtures], DataFrame]):
        name = function.__name__
        QUERIES[name] = lambda spark, folder: function(Fixtures(spark, folder))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def r6(column: str):
    return F.round(F.col(column), 6).alias(column)


# --- graph ---------------------------------------------------------------------------------------------------


@query(f"WITH {GRAPH} SELECT i, j, v FROM adj")
def adjacency_symmetric(f: Fixtures) -> DataFrame:
    return graph.adjacency(f.edges()).select("i", "j", "v")


@query(f"WITH {GRAPH} SELECT (SELECT n FROM n) AS n, CAST(count(*) AS BIGINT) AS edges FROM edges")
def graph_size(f: Fixtures) -> DataFrame:
    return f.edges().agg((F.max(F.greatest("src", "dst")) + 1).alias("n"), F.count("*").alias("edges"))


@query(f"WITH {GRAPH} SELECT node, coalesce(d, 0.0) AS d, round((SELECT sum(v) FROM adj) / (SELECT n FROM n), 6) AS tau FROM verts LEFT JOIN deg ON node = i")
def degree(f: Fixtures) -> DataFrame:
    m, nodes = f.kept_adjacency(), graph.vertices(f.kept_edges())
    tau = graph.mean_degree(m, nodes.count())
    return nodes.join(graph.degrees(m), F.col("node") == F.col("i"), "left").select("node", F.coalesce("d", F.lit(0.0)).alias("d"), F.round(F.lit(tau), 6).alias("tau"))


@query(f"WITH {GRAPH} SELECT i, j, round(sum(v), 6) AS v FROM (SELECT * FROM adj UNION ALL SELECT i, i, d / n FROM deg, n) GROUP BY i, j")
def adj_plus_diag(f: Fixtures) -> DataFrame:
    return graph.add_diagonal(f.kept_adjacency(), graph.vertex_count(f.kept_edges())).select("i", "j", r6("v"))


@query(f"WITH {GRAPH} SELECT i, j, sum(v) AS v FROM (SELECT i, i AS j, d AS v FROM deg UNION ALL SELECT i, j, -v FROM adj) GROUP BY i, j HAVING sum(v) <> 0")
def laplacian_entries(f: Fixtures) -> DataFrame:
    return graph.laplacian(f.kept_adjacency()).select("i", "j", "v")


def _lap(shift: str) -> str:
    return f"""WITH {GRAPH}, t AS (SELECT {shift} AS tau)
  SELECT i, j, round(sum(v), 6) AS v FROM (SELECT node AS i, node AS j, CAST(1 AS DOUBLE) AS v FROM verts UNION ALL
    SELECT adj.i, adj.j, -adj.v / sqrt((x.d + tau) * (y.d + tau)) FROM adj JOIN deg x ON adj.i = x.i JOIN deg y ON adj.j = y.i, t) GROUP BY i, j HAVING sum(v) <> 0"""


@query(_lap("0.0"))
def norm_laplacian_entries(f: Fixtures) -> DataFrame:
    return graph.normalized_laplacian(f.kept_adjacency(), graph.vertices(f.kept_edges())).select("i", "j", r6("v"))


@query(_lap("(SELECT sum(v) FROM adj) / (SELECT n FROM n)"))
def reg_norm_laplacian_entries(f: Fixtures) -> DataFrame:
    m, nodes = f.kept_adjacency(), graph.vertices(f.kept_edges())
    return graph.regularized_laplacian(m, nodes, graph.mean_degree(m, nodes.count())).select("i", "j", r6("v"))


@query(f"WITH {GRAPH} SELECT adj.i, j, round(v / d, 6) AS v FROM adj JOIN deg ON adj.i = deg.i")
def row_stochastic(f: Fixtures) -> DataFrame:
    return graph.stochastic(graph.adjacency(f.edges()), "i").select("i", "j", r6("v"))


@query(f"WITH {GRAPH} SELECT adj.i, j, round(v / d, 6) AS v FROM adj JOIN deg ON adj.j = deg.i")
def column_stochastic(f: Fixtures) -> DataFrame:
    return graph.stochastic(graph.adjacency(f.edges()), "j").select("i", "j", r6("v"))


# --- attributes ----------------------------------------------------------------------------------------------

KINDS = ("brand", "word", "ptype")
IN_KINDS = "type IN ('brand', 'word', 'ptype')"
FREQ = f"{ATTRS}, freq AS (SELECT type, val, count(*) AS freq FROM attrs WHERE {IN_KINDS} GROUP BY type, val)"
RANKED = f"""{FREQ}, ranked AS (SELECT type, row_number() OVER w - 1 AS rank, val, freq, 100.0 * sum(freq) OVER (w ROWS UNBOUNDED PRECEDING) / sum(freq) OVER (PARTITION BY type) AS cumulative_pct
  FROM freq WINDOW w AS (PARTITION BY type ORDER BY freq DESC, val))"""


@query(f"WITH {RANKED} SELECT type, CAST(rank AS INTEGER) AS rank, val, freq, round(cumulative_pct, 6) AS cumulative_pct FROM ranked WHERE rank < 100")
def attr_freq_rank(f: Fixtures) -> DataFrame:
    return Attributes(f.attributes(), KINDS).ranked(100).select("type", "rank", "val", "freq", r6("cumulative_pct"))


@query(f"WITH {FREQ} SELECT type, count(*) AS n_values, CAST(sum(freq) AS BIGINT) AS n_instances FROM freq GROUP BY type")
def attr_type_totals(f: Fixtures) -> DataFrame:
    return Attributes(f.attributes(), KINDS).totals()


@query(f"WITH {ATTRS} SELECT DISTINCT node FROM attrs WHERE {IN_KINDS}")
def attributed_nodes(f: Fixtures) -> DataFrame:
    return Attributes(f.attributes(), KINDS).nodes()


@query(f"WITH {ATTRS} SELECT type, node, string_agg(val, ',' ORDER BY val) AS vals FROM (SELECT DISTINCT type, node, val FROM attrs WHERE {IN_KINDS}) GROUP BY type, node")
def attr_values_per_node(f: Fixtures) -> DataFrame:
    return Attributes(f.attributes(), KINDS).value_sets().select("type", "node", F.array_join("vals", ",").alias("vals"))


IND = f"{NODES}, {ATTRS}, ind AS (SELECT nodes.node, max(CASE WHEN val = 'ECONOMY' THEN 1.0 WHEN val IS NOT NULL THEN 0.0 END)::DOUBLE AS ind FROM nodes LEFT JOIN attrs ON nodes.node = attrs.node AND type = 'ptype' GROUP BY nodes.node)"


@query(f"WITH {IND} SELECT node, ind FROM ind")
def attr_indicator(f: Fixtures) -> DataFrame:
    return Attributes(f.attributes()).indicator(f.nodes(), "ptype", "ECONOMY")


@query(f"WITH {IND} SELECT count(*) FILTER (ind = 1) AS n_true, count(*) FILTER (ind = 0) AS n_false, count(*) FILTER (ind IS NULL) AS n_unknown, round(avg(ind), 6) AS guess_rate FROM ind")
def seed_class_counts(f: Fixtures) -> DataFrame:
    return seed_counts(Attributes(f.attributes()).indicator(f.nodes(), "ptype", "ECONOMY")).withColumn("guess_rate", F.round("guess_rate", 6))


@query(f"""WITH {FREQ}, known AS (SELECT type, count(DISTINCT node) AS total_known FROM attrs WHERE {IN_KINDS} GROUP BY type)
  SELECT freq.type, val, freq, round(freq / sum(freq) OVER (PARTITION BY freq.type), 6) AS relative_freq, CAST(row_number() OVER w AS INTEGER) AS rank,
    round(sum(freq) OVER (w ROWS UNBOUNDED PRECEDING) / sum(freq) OVER (PARTITION BY freq.type), 6) AS percentile, total_known
  FROM freq JOIN known ON freq.type = known.type WINDOW w AS (PARTITION BY freq.type ORDER BY freq DESC, val)""")
def selected_attr_stats(f: Fixtures) -> DataFrame:
    return Attributes(f.attributes(), KINDS).selected_stats().select("type", "val", "freq", r6("relative_freq"), "rank", r6("percentile"), "total_known")


@query(f"WITH {RANKED} SELECT type, val, round(log10(rank + 1), 6) AS log_rank, round(log10(freq), 6) AS log_freq FROM ranked")
def loglog_rank(f: Fixtures) -> DataFrame:
    return log_ranks(Attributes(f.attributes(), KINDS).ranked(None)).select("type", "val", r6("log_rank"), r6("log_freq"))


@query(f"""WITH {RANKED}, tot AS (SELECT type, count(*) AS k, sum(freq) AS s FROM freq GROUP BY type), shown AS (
    SELECT type, -2 AS ord, '=== ' || type || ' ===' AS value FROM tot UNION ALL SELECT type, -1, k || ' values, ' || s || ' instances' FROM tot
    UNION ALL SELECT type, rank, printf('%d\t%s\t%d\t%.4f', rank, val, freq, cumulative_pct) FROM ranked WHERE rank < 10)
  SELECT CAST(row_number() OVER (ORDER BY type, ord) - 1 AS INTEGER) AS line, value FROM shown""")
def attr_report(f: Fixtures) -> DataFrame:
    return Attributes(f.attributes(), KINDS).report(10)


_SETTINGS = ", ".join(map(str, evaluate.SEED_SETTINGS))


@query(f"WITH {FREQ} SELECT type, val, freq, pos_seeds, neg_seeds FROM freq, (VALUES {_SETTINGS}) AS s(pos_seeds, neg_seeds) WHERE freq >= 2 * pos_seeds")
def harness_runs(f: Fixtures) -> DataFrame:
    return evaluate.harness_runs(Attributes(f.attributes(), KINDS).frequencies())


# --- co-occurrence -------------------------------------------------------------------------------------------


def _counts(f: Fixtures, kind: str = "word") -> cooccur.PairCounts:
    return cooccur.count_pairs(f.edges(), f.values(kind), f.nodes())


@query(f"WITH {pairs_sql('word')} SELECT val, row_number() OVER (ORDER BY val) - 1 AS idx FROM vocab")
def vocabulary_index(f: Fixtures) -> DataFrame:
    return cooccur.vocabulary(f.values("word"), f.nodes())


@query(f"WITH {pairs_sql('word')} SELECT a, b, c FROM pairs")
def pair_counts(f: Fixtures) -> DataFrame:
    return cooccur.pair_counts(f.edges(), f.values("word"))


@query(f"WITH {pairs_sql('word')} SELECT val, m, t AS total FROM marg, tot")
def value_marginals(f: Fixtures) -> DataFrame:
    c = _counts(f)
    return c.marginals.select("val", "m", F.lit(c.total).alias("total"))


def _sim(name: str, kind: str, formula: str, delta: float = 0.0):
    def run(f: Fixtures) -> DataFrame:
        return cooccur.measured(_counts(f, kind), name, delta).select("a", "b", r6("s"))

    run.__name__ = {"PMIs": "sim_pmi", "PMId": "sim_pmi_distance", "NPMI1s": "sim_npmi1s", "NPMI1d": "sim_npmi1d", "NPMI2s": "sim_npmi2s", "NPMI2d": "sim_npmi2d", "conditional_prob": "sim_conditional"}[name] + ("_smoothed" if delta else "")
    query(f"WITH {probs_sql(kind, delta)} SELECT a, b, round({formula}, 6) AS s FROM p")(run)


_NPMI = "CASE WHEN pab = 1 THEN 0 ELSE (ln(pa) + ln(pb)) / (2 * ln(pab)) END"
_sim("PMIs", "word", "ln(pab) - ln(pa) - ln(pb)")
_sim("PMId", "word", "-(ln(pab) - ln(pa) - ln(pb))")
_sim("NPMI1s", "word", _NPMI)
_sim("NPMI1d", "word", f"1 - {_NPMI}")
_sim("NPMI2s", "word", f"-ln(1 - {_NPMI}) / ln(2)")
_sim("NPMI2d", "word", f"-ln({_NPMI}) / ln(2)")
_sim("conditional_prob", "word", "pab / pb")
_sim("PMIs", "word", "ln(pab) - ln(pa) - ln(pb)", 0.5)


@query(f"WITH {probs_sql('brand')} SELECT a, b, c, round({_NPMI}, 6) AS s FROM p")
def npmi_brand(f: Fixtures) -> DataFrame:
    p = cooccur.with_probabilities(_counts(f, "brand"))
    return p.select("a", "b", "c", F.round(M.npmi1_s(F.col("pab"), F.col("pa"), F.col("pb")), 6).alias("s"))


@query(f"WITH {probs_sql('word', 0.5)} SELECT a, b, round(pa, 9) AS pa, round(pb, 9) AS pb, round(pab, 9) AS pab FROM p")
def empirical_probabilities(f: Fixtures) -> DataFrame:
    return cooccur.with_probabilities(_counts(f), 0.5).select("a", "b", *[F.round(c, 9).alias(c) for c in ("pa", "pb", "pab")])


# --- linear operators ----------------------------------------------------------------------------------------

X = "xs AS (SELECT node AS id, CAST(node % 7 + 1 AS DOUBLE) AS x FROM verts)"
FULL = f"{GRAPH}, {X}"
AX = "ax AS (SELECT i AS id, sum(v * x) AS x FROM adj JOIN xs ON j = xs.id GROUP BY i)"


def _vector(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node").alias("id"), F.lit(0).cast("long").alias("col"), (F.col("node") % 7 + 1).cast("double").alias("x"))


def _result(op: algebra.Operator, x: DataFrame) -> DataFrame:
    return op.apply(x, 1).select("id", F.round("x", 5).alias("x"))


def _adjacency(f: Fixtures) -> tuple[int, DataFrame, DataFrame]:
    n = graph.vertex_count(f.kept_edges())
    return n, f.kept_adjacency(), _vector(graph.vertices(f.kept_edges()))


@query(f"WITH {FULL}, {AX} SELECT id, round(x, 5) AS x FROM ax")
def matvec_adj(f: Fixtures) -> DataFrame:
    n, m, x = _adjacency(f)
    return _result(algebra.sparse((n, n), m, True), x)


@query(f"WITH {FULL}, {AX} SELECT xs.id, round(xs.x - 2 * coalesce(ax.x, 0) + 3 * coalesce(ax.x, 0) + 0.5 * d * xs.x + (SELECT sum(x) FROM xs), 5) AS x FROM xs LEFT JOIN ax ON xs.id = ax.id JOIN deg ON xs.id = deg.i")
def matvec_tree(f: Fixtures) -> DataFrame:
    """Sum, scale, negation, diagonal, constant diagonal and a number added to every entry, in one tree."""
    n, m, x = _adjacency(f)
    a = algebra.sparse((n, n), m, True)
    d = algebra.diagonal(n, graph.degrees(m).select(F.col("i").alias("id"), "d"))
    return _result(algebra.constant_diagonal(n, 1.0) - 2.0 * a + 3.0 * a + 0.5 * d + 1.0, x)


@query(f"WITH {FULL}, {AX} SELECT i AS id, round(sum(v * x), 5) AS x FROM adj JOIN ax ON j = ax.id GROUP BY i")
def matvec_product(f: Fixtures) -> DataFrame:
    n, m, x = _adjacency(f)
    a = algebra.sparse((n, n), m, True)
    return _result(a * a, x)


@query(f"WITH {FULL} SELECT i AS id, round(d * (SELECT sum(x) FROM xs) + (SELECT sum(d * x) FROM xs JOIN deg ON id = i) + d * (SELECT sum(x * x) FROM xs), 5) AS x FROM deg")
def matvec_rank_one(f: Fixtures) -> DataFrame:
    n, m, x = _adjacency(f)
    u = graph.degrees(m).select(F.col("i").alias("id"), F.col("d").alias("w"))
    v = x.select("id", F.col("x").alias("w"))
    return _result(algebra.replicated_column(n, u) + algebra.replicated_row(n, u) + algebra.rank_one((n, n), u, v), x)


@query(f"WITH {FULL} SELECT xs.id, round(xs.x - coalesce(s, 0), 5) AS x FROM xs LEFT JOIN (SELECT adj.i, sum(adj.v * x / sqrt(p.d * q.d)) AS s FROM adj JOIN deg p ON adj.i = p.i JOIN deg q ON adj.j = q.i JOIN xs ON adj.j = id GROUP BY adj.i) ON xs.id = i")
def matvec_norm_laplacian(f: Fixtures) -> DataFrame:
    n, m, x = _adjacency(f)
    return _result(algebra.normalized_laplacian(n, m), x)


BLOCK_X = "bx AS (SELECT id, x FROM xs UNION ALL SELECT id + n, 2 * x FROM xs, n)"


@query(f"WITH {FULL}, {AX}, {BLOCK_X} SELECT id, round(x, 5) AS x FROM (SELECT id, x + 2 * (id % 7 + 1) AS x FROM ax UNION ALL SELECT ax.id + n, (ax.id % 7 + 1) + 2 * 2 * ax.x FROM ax, n)")
def block_matvec(f: Fixtures) -> DataFrame:
    n, m, x = _adjacency(f)
    a, one = algebra.sparse((n, n), m, True), algebra.constant_diagonal(n, 1.0)
    both = x.unionByName(x.select((F.col("id") + n).alias("id"), "col", (2 * F.col("x")).alias("x")))
    return _result(algebra.blocks([[a, one], [one, 2.0 * a]]), both)


@query(f"""WITH {FULL}, {AX} SELECT id, round(x, 5) AS x FROM (
    SELECT ax.id, ax.x + 0.5 * (2 * ax.x + 2 * xs.x * d) + 3 * 2 * xs.x AS x FROM ax JOIN xs ON ax.id = xs.id JOIN deg ON ax.id = i
    UNION ALL SELECT ax.id + n, 2 * d * xs.x + 0.5 * (ax.x + xs.x * d) + 3 * xs.x FROM ax JOIN xs ON ax.id = xs.id JOIN deg ON ax.id = i, n)""")
def joint_block_matvec(f: Fixtures) -> DataFrame:
    n, m, x = _adjacency(f)
    a, d = algebra.sparse((n, n), m, True), algebra.diagonal(n, graph.degrees(m).select(F.col("i").alias("id"), "d"))
    both = x.unionByName(x.select((F.col("id") + n).alias("id"), "col", (2 * F.col("x")).alias("x")))
    return _result(algebra.joint_blocks([a, d], 3.0), both)


def _value_matrix(f: Fixtures, kind: str = "word") -> tuple[cooccur.PairCounts, DataFrame, DataFrame, DataFrame]:
    words = cooccur.vocabulary(f.values(kind), f.nodes())
    named = f.nodes().join(f.values(kind), "node", "left").select("node", F.coalesce("val", F.concat(F.lit("*???*_"), F.col("node").cast("string"))).alias("val"))
    return _counts(f, kind), words, named, named.join(words, "val").select("node", F.col("idx").alias("image"))


COLLAPSE = "idx AS (SELECT val, row_number() OVER (ORDER BY val) - 1 AS k FROM vocab), cm AS (SELECT k AS i, named.node AS j, 1.0 / count(*) OVER (PARTITION BY named.node) AS v FROM (SELECT nodes.node, coalesce(vals.val, '*???*_' || nodes.node) AS val FROM nodes LEFT JOIN vals ON nodes.node = vals.node) named JOIN idx ON named.val = idx.val)"


@query(f"WITH {pairs_sql('word')}, {COLLAPSE} SELECT i, j, round(v, 6) AS v FROM cm")
def collapse_matrix(f: Fixtures) -> DataFrame:
    return algebra.collapse_matrix(_value_matrix(f)[3]).select("i", "j", r6("v"))


_PMI_SQL = f"""WITH {pairs_sql('word')}, idx AS (SELECT val, row_number() OVER (ORDER BY val) - 1 AS k, CAST((row_number() OVER (ORDER BY val) - 1) % 7 + 1 AS DOUBLE) AS x FROM vocab),
  u AS (SELECT idx.val, idx.k AS id, x, ln(coalesce(m, 0) + 0.5 * tot.k) AS u FROM idx LEFT JOIN marg ON idx.val = marg.val, tot),
  fm AS (SELECT a, b, ln(c + 0.5) - ln(0.5) AS v FROM pairs UNION ALL SELECT b, a, ln(c + 0.5) - ln(0.5) FROM pairs WHERE a <> b),
  fx AS (SELECT a AS val, sum(v * x) AS s FROM fm JOIN idx ON b = idx.val GROUP BY a)
  SELECT id, round(coalesce(s, 0) + (ln(0.5) + ln(t + 0.5 * k * (k + 1) / 2) - u) * (SELECT sum(x) FROM idx) - (SELECT sum(u * x) FROM u), 5) AS x FROM u LEFT JOIN fx ON u.val = fx.val, tot"""


@query(_PMI_SQL)
def matvec_pmi(f: Fixtures) -> DataFrame:
    import math

    c, words, _, _ = _value_matrix(f)
    sparse, constant, u = cooccur.smoothed_pmi_parts(c, 0.5)
    at = lambda side: words.select(F.col("val").alias(side), F.col("idx").alias(f"{side}x"))
    m = sparse.join(at("i"), "i").join(at("j"), "j").select(F.col("ix").alias("i"), F.col("jx").alias("j"), "v")
    full = words.join(u, "val", "left").select(F.col("idx").alias("id"), F.coalesce("u", F.lit(math.log(0.5 * c.values))).alias("w"))
    return _result(algebra.pmi(c.values, m, constant, full), _vector(words.select(F.col("idx").alias("node"))))


@query(f"""WITH {probs_sql('word')}, {COLLAPSE},
  sm AS (SELECT a, b, {_NPMI} AS v FROM p UNION ALL SELECT b, a, {_NPMI} FROM p WHERE a <> b),
  c1 AS (SELECT i, sum(v * (j % 7 + 1)) AS x FROM cm GROUP BY i),
  s1 AS (SELECT y.k AS i, sum(v * c1.x) AS x FROM sm JOIN idx z ON b = z.val JOIN c1 ON z.k = c1.i JOIN idx y ON a = y.val GROUP BY y.k)
  SELECT j AS id, round(sum(v * s1.x), 5) AS x FROM cm JOIN s1 ON cm.i = s1.i GROUP BY j""")
def matvec_uncollapsed(f: Fixtures) -> DataFrame:
    from .embeddings import node_operator

    return _result(node_operator(f.edges(), f.values("word"), f.nodes(), "NPMI1s", 0.0), _vector(f.nodes()))


# --- features ------------------------------------------------------------------------------------------------

PIVOT = f"{NODES}, {ATTRS}, wide AS (SELECT nodes.node, max(CASE WHEN type = 'size' THEN TRY_CAST(val AS DOUBLE) END) AS size, max(CASE WHEN type = 'retailprice' THEN TRY_CAST(val AS DOUBLE) END) AS retailprice FROM nodes LEFT JOIN attrs ON nodes.node = attrs.node GROUP BY nodes.node)"
NUMERIC = ("size", "retailprice")


@query(f"WITH {PIVOT} SELECT node, size, retailprice FROM wide")
def numeric_pivot(f: Fixtures) -> DataFrame:
    return features.numeric_pivot(f.attributes(), NUMERIC, f.nodes())


@query(f"WITH {PIVOT} SELECT node, round(coalesce(size, (SELECT avg(size) FROM wide)), 6) AS size, round(coalesce(retailprice, (SELECT avg(retailprice) FROM wide)), 6) AS retailprice FROM wide")
def impute_mean(f: Fixtures) -> DataFrame:
    return features.impute(features.numeric_pivot(f.attributes(), NUMERIC, f.nodes()), NUMERIC).select("node", r6("size"), r6("retailprice"))


@query(f"WITH {PIVOT} SELECT node, round(coalesce(size, (SELECT median(size) FROM wide)), 6) AS size, round(coalesce(retailprice, (SELECT median(retailprice) FROM wide)), 6) AS retailprice FROM wide")
def impute_median(f: Fixtures) -> DataFrame:
    return features.impute(features.numeric_pivot(f.attributes(), NUMERIC, f.nodes()), NUMERIC, "median").select("node", r6("size"), r6("retailprice"))


@query(f"WITH {LONG}, st AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY pos) SELECT node, CAST(long.pos AS INTEGER) AS pos, round((x - m) / s, 6) AS x FROM long JOIN st ON long.pos = st.pos")
def zscore(f: Fixtures) -> DataFrame:
    return features.zscored(f.features(), 64).select("node", F.posexplode("features").alias("pos", "x")).select("node", "pos", r6("x"))


@query(f"WITH {LONG} SELECT node, CAST(pos AS INTEGER) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY node)), 6) AS x FROM long")
def sphere_rows(f: Fixtures) -> DataFrame:
    return features.on_sphere(f.features()).select("node", F.posexplode("features").alias("pos", "x")).select("node", "pos", r6("x"))


@query(f"WITH {LONG} SELECT node, CAST(pos + 64 * k AS INTEGER) AS pos, round(CASE WHEN k = 0 THEN x ELSE x / sqrt(sum(x * x) OVER (PARTITION BY node, k)) END, 6) AS x FROM long, (VALUES (0), (1)) AS t(k)")
def stack_features(f: Fixtures) -> DataFrame:
    own = f.features()
    return features.stacked(own.select("node"), [own, features.on_sphere(own)]).select("node", F.posexplode("features").alias("pos", "x")).select("node", "pos", r6("x"))


# --- models and evaluation -----------------------------------------------------------------------------------

NB = f"""{LONG}, mom AS (SELECT CAST(ind AS INTEGER) AS label, pos, avg(x) AS m, var_pop(x) AS v FROM long WHERE ind IS NOT NULL GROUP BY 1, 2),
  adds AS (SELECT 1e-9 * max(v) AS a FROM (SELECT var_pop(x) AS v FROM long WHERE ind IS NOT NULL GROUP BY pos)),
  cls AS (SELECT CAST(ind AS INTEGER) AS label, count(*) AS n FROM feats WHERE ind IS NOT NULL GROUP BY 1)"""


@query(f"""WITH {NB}, j AS (SELECT node, mom.label, sum(-0.5 * ln(2 * pi() * (v + a)) - (x - m) * (x - m) / (2 * (v + a))) + ln(max(n) / (SELECT sum(n) FROM cls)) AS l
    FROM long JOIN mom ON long.pos = mom.pos JOIN cls ON mom.label = cls.label, adds WHERE ind IS NULL GROUP BY node, mom.label)
  SELECT a.node, round(1 / (1 + exp(b.l - a.l)), 6) AS prob FROM j a JOIN j b ON a.node = b.node AND a.label = 1 AND b.label = 0""")
def naive_bayes_scores(f: Fixtures) -> DataFrame:
    rows = f.features()
    return models.naive_bayes(rows.where("ind is not null"), rows.where("ind is null")).select("node", r6("prob"))


KDE = f"""{FEATURES}, pr AS (SELECT q.node, CAST(t.ind AS INTEGER) AS label, t.node AS other, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS d FROM feats q, feats t WHERE t.ind IS NOT NULL)"""


@query(f"""WITH {KDE}, den AS (SELECT pr.node, label, ln(sum(exp(-d * d / (2 * 0.09)))) - ln(count(*)) AS s FROM pr JOIN feats ON pr.node = feats.node WHERE feats.ind IS NULL GROUP BY pr.node, label),
  cls AS (SELECT count(*) FILTER (ind = 1) AS n1, count(*) FILTER (ind = 0) AS n0 FROM feats)
  SELECT a.node, round(a.s - b.s + ln((n1 + 1) / (n0 + 1)), 6) AS score FROM den a JOIN den b ON a.node = b.node AND a.label = 1 AND b.label = 0, cls""")
def kde_log_ratio(f: Fixtures) -> DataFrame:
    rows = f.features()
    return models.TwoClassKDE((0.3, 0.3)).fit(rows.where("ind is not null")).score_samples(rows.where("ind is null")).select("node", r6("score"))


@query(f"""WITH {LONG}, sg AS (SELECT label, max(n) AS n, sqrt(avg(v)) AS s FROM (SELECT CAST(ind AS INTEGER) AS label, pos, var_pop(x) AS v, count(*) AS n FROM long WHERE ind IS NOT NULL GROUP BY 1, 2) GROUP BY label),
  grid AS (SELECT label, 1.06 * s * pow(n, -0.2) * pow(100.0, step / 30.0 - 0.5) AS h FROM sg, (SELECT unnest(range(0, 31)) AS step)),
  fo AS (SELECT node, CAST(ind AS INTEGER) AS label, embedding, ((node * 7919) % 10007) % 10 AS fold FROM feats WHERE ind IS NOT NULL),
  pr AS (SELECT a.node, a.label, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM fo a JOIN fo b ON a.label = b.label AND a.fold <> b.fold),
  mx AS (SELECT pr.node, pr.label, h, max(-d * d / (2 * h * h)) AS t FROM pr JOIN grid ON pr.label = grid.label GROUP BY 1, 2, 3),
  ls AS (SELECT mx.node, mx.label, mx.h, max(t) + ln(sum(exp(-d * d / (2 * mx.h * mx.h) - t))) - ln(count(*)) AS l FROM pr JOIN mx ON pr.node = mx.node AND pr.label = mx.label GROUP BY 1, 2, 3)
  SELECT label, round(h, 6) AS bandwidth, round(sum(l - 32 * ln(2 * pi()) - 64 * ln(h)), 3) AS score FROM ls GROUP BY label, h""")
def kde_bandwidth_grid(f: Fixtures) -> DataFrame:
    return models.bandwidth_scores(f.features().where("ind is not null"), 64, Config().kde_grid).select("label", r6("bandwidth"), F.round("score", 3).alias("score"))


LOO = f"""{LONG}, known AS (SELECT * FROM long WHERE ind IS NOT NULL),
  su AS (SELECT ind AS label, pos, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM known GROUP BY 1, 2),
  adds AS (SELECT 1e-9 * max(v) AS a FROM (SELECT var_pop(x) AS v FROM known GROUP BY pos)),
  tot AS (SELECT count(*) AS t FROM feats WHERE ind IS NOT NULL),
  st AS (SELECT node, ind, label, x, n - (ind = label)::INTEGER AS n, s - (ind = label)::INTEGER * x AS s, q - (ind = label)::INTEGER * x * x AS q FROM known JOIN su ON known.pos = su.pos),
  mv AS (SELECT node, ind, label, x, n, s / n AS m, q / n - (s / n) * (s / n) + a AS v FROM st, adds),
  j AS (SELECT node, ind, label, sum(-0.5 * ln(2 * pi() * v) - (x - m) * (x - m) / (2 * v)) + ln(max(n) / (SELECT t - 1 FROM tot)) AS l FROM mv GROUP BY 1, 2, 3),
  loo AS (SELECT a.node, a.ind, 1 / (1 + exp(b.l - a.l)) AS prob FROM j a JOIN j b ON a.node = b.node AND a.label = 1 AND b.label = 0)"""


@query(f"WITH {LOO} SELECT node, CAST(ind AS DOUBLE) AS ind, round(prob, 6) AS prob FROM loo")
def loo_naive_bayes(f: Fixtures) -> DataFrame:
    return evaluate.leave_one_out_bayes(f.features().where("ind is not null")).select("node", "ind", r6("prob"))


@query(f"""WITH {KDE}, den AS (SELECT pr.node, feats.ind, label, ln(sum(exp(-d * d / (2 * 0.09)))) - ln(count(*)) AS s FROM pr JOIN feats ON pr.node = feats.node WHERE feats.ind IS NOT NULL AND pr.node <> other GROUP BY 1, 2, 3),
  cls AS (SELECT count(*) FILTER (ind = 1) AS n1, count(*) FILTER (ind = 0) AS n0 FROM feats)
  SELECT a.node, round(1 - 1 / (1 + exp(a.s - b.s + ln((n1 + 1) / (n0 + 1)))), 6) AS p1 FROM den a JOIN den b ON a.node = b.node AND a.label = 1 AND b.label = 0, cls""")
def loo_kde(f: Fixtures) -> DataFrame:
    seeds = f.features().where("ind is not null")
    return models.TwoClassKDE((0.3, 0.3)).fit(seeds).predict_proba(seeds, exclude_self=True).select("node", r6("p1"))


SCORED = "sc AS (SELECT vec_id AS node, embedding[1]::DOUBLE AS prob, CASE WHEN label = 2 THEN 1.0 ELSE 0.0 END AS ind FROM embeddings), cu AS (SELECT row_number() OVER w AS rank, node, prob, ind, sum(ind) OVER (w ROWS UNBOUNDED PRECEDING) / row_number() OVER w AS cum_prec FROM sc WINDOW w AS (ORDER BY prob DESC, node))"


def _scored(f: Fixtures) -> DataFrame:
    rows = f.table("embeddings")
    return rows.select(F.col("vec_id").alias("node"), F.element_at("embedding", 1).cast("double").alias("prob"), F.when(F.col("label") == 2, 1.0).otherwise(0.0).alias("ind"))


@query(f"WITH {SCORED} SELECT CAST(rank AS INTEGER) AS rank, node, round(cum_prec, 6) AS cum_prec FROM cu")
def cumulative_precision(f: Fixtures) -> DataFrame:
    return evaluate.cumulative_precision(_scored(f)).select("rank", "node", r6("cum_prec"))


@query(f"WITH {SCORED} SELECT round(avg(cum_prec), 6) AS mean_cum_precision, round(avg(ind), 6) AS guess_rate, round(avg(cum_prec) FILTER (ind = 1), 6) AS average_precision FROM cu")
def average_precision(f: Fixtures) -> DataFrame:
    return evaluate.mean_cumulative_precision(evaluate.cumulative_precision(_scored(f))).select(r6("mean_cum_precision"), r6("guess_rate"), r6("average_precision"))


DEAL = "(node * 7919 + {s} * 104729) % 10007"


@query(f"WITH {FEATURES}, kn AS (SELECT node, CAST(ind AS DOUBLE) AS ind FROM feats WHERE ind IS NOT NULL) SELECT node, ind, row_number() OVER (PARTITION BY ind ORDER BY {DEAL.format(s=7)}, node) <= least(CASE WHEN ind = 1 THEN 20 ELSE 40 END, count(*) OVER (PARTITION BY ind) - 1) AS train FROM kn")
def seed_sample(f: Fixtures) -> DataFrame:
    return evaluate.seed_sample(f.features().where("ind is not null"), 20, 40, 7)


@query(f"WITH {FEATURES}, kn AS (SELECT node, CAST(ind AS DOUBLE) AS ind, row_number() OVER (PARTITION BY ind ORDER BY {DEAL.format(s=123)}, node) AS turn FROM feats WHERE ind IS NOT NULL) SELECT CAST(row_number() OVER (ORDER BY turn, ind DESC) AS INTEGER) AS place, node, ind FROM kn ORDER BY turn, ind DESC LIMIT 100")
def cv_interleave(f: Fixtures) -> DataFrame:
    return evaluate.interleaved(f.features().where("ind is not null"), 100, 123)


_MC_CURVE = f"""WITH {LONG}, kn AS (SELECT f.node, f.ind, s.sample, row_number() OVER (PARTITION BY s.sample, ind ORDER BY {DEAL.format(s='s.sample')}, node) <= least(CASE WHEN ind = 1 THEN 20 ELSE 40 END, count(*) OVER (PARTITION BY s.sample, ind) - 1) AS train
    FROM feats f, (SELECT unnest(range(0, 50)) AS sample) s WHERE ind IS NOT NULL),
  lo AS (SELECT kn.sample, kn.node, kn.ind, kn.train, pos, x FROM kn JOIN long ON kn.node = long.node),
  ad AS (SELECT sample, 1e-9 * max(v) AS a FROM (SELECT sample, pos, var_pop(x) AS v FROM lo WHERE train GROUP BY 1, 2) GROUP BY sample),
  st AS (SELECT lo.sample, ind AS label, pos, avg(x) AS m, var_pop(x) + max(a) AS v, count(*) AS n FROM lo JOIN ad ON lo.sample = ad.sample WHERE train GROUP BY 1, 2, 3),
  j AS (SELECT lo.sample, node, ind, label, sum(-0.5 * ln(2 * pi() * v) - (x - m) * (x - m) / (2 * v)) + ln(max(n)) AS l FROM lo JOIN st ON lo.sample = st.sample AND lo.pos = st.pos WHERE NOT train GROUP BY 1, 2, 3, 4),
  od AS (SELECT a.sample, a.node, a.ind, a.l - b.l AS prob FROM j a JOIN j b ON a.sample = b.sample AND a.node = b.node AND a.label = 1 AND b.label = 0),
  cu AS (SELECT sample, row_number() OVER w AS rank, sum(ind) OVER (w ROWS UNBOUNDED PRECEDING) / row_number() OVER w AS p FROM od WINDOW w AS (PARTITION BY sample ORDER BY prob DESC, node))
  SELECT CAST(rank AS INTEGER) AS rank, round(avg(p), 6) AS mean_prec, round(stddev_pop(p) / sqrt(count(*)), 6) AS stderr_prec, round(avg(p) - 2 * stddev_pop(p) / sqrt(count(*)), 6) AS low, round(avg(p) + 2 * stddev_pop(p) / sqrt(count(*)), 6) AS high FROM cu WHERE rank <= 50 GROUP BY rank"""


@query(_MC_CURVE)
def mc_precision_curve(f: Fixtures) -> DataFrame:
    return evaluate.resampled_bayes(f.features().where("ind is not null"), 50, 20, 40, 50).select("rank", *[r6(c) for c in ("mean_prec", "stderr_prec", "low", "high")])


@query()
def mc_precision_boost(f: Fixtures) -> DataFrame:
    """The harness's curve of boosted stumps, 50 samples."""
    curve = evaluate.resampled_boost(f.features().where("ind is not null"), 50, 20, 40, 50, Config().num_trees)
    return curve.select("rank", *[r6(c) for c in ("mean_prec", "stderr_prec", "low", "high")])


@query(f"""WITH {NB}, j AS (SELECT node, mom.label, sum(-0.5 * ln(2 * pi() * (v + a)) - (x - m) * (x - m) / (2 * (v + a))) + ln(max(n) / (SELECT sum(n) FROM cls)) AS l
    FROM long JOIN mom ON long.pos = mom.pos JOIN cls ON mom.label = cls.label, adds WHERE ind IS NULL GROUP BY node, mom.label)
  SELECT a.node, round(1 / (1 + exp(b.l - a.l)), 9) AS prob FROM j a JOIN j b ON a.node = b.node AND a.label = 1 AND b.label = 0 ORDER BY 1 / (1 + exp(b.l - a.l)) DESC, a.node LIMIT 50""")
def nominate_bayes(f: Fixtures) -> DataFrame:
    """The flagship: the 50 likeliest of the unknown rows. The top k is what it is for."""
    rows = f.features()
    return nominate(models.naive_bayes(rows.where("ind is not null"), rows.where("ind is null")), 50).select("node", F.round("prob", 9).alias("prob"))


def _nominated(name: str, **options):
    def run(f: Fixtures) -> DataFrame:
        rows = f.features()
        return nominate(models.classify(name, rows.where("ind is not null"), rows.where("ind is null"), **options), Config().nominate_max)

    run.__name__ = f"{name}_nominate"
    query()(run)


@query("SELECT CAST(unnest(range(0, 65)) AS INTEGER) AS pos, CAST(0 AS DOUBLE) AS gradient")
def logreg_gradient(f: Fixtures) -> DataFrame:
    """The gradient of the penalised loss at the weights found, the intercept's last: 0 at the optimum."""
    rows = f.features().where("ind is not null")
    w = models.logreg_weights(rows)
    p = models.logreg_chance(w)
    pull = rows.select((p - F.col("ind")).alias("e"), F.concat("features", F.array(F.lit(1.0))).alias("x")).select("e", F.posexplode("x").alias("pos", "x"))
    own = F.element_at(F.array(*[F.lit(float(v)) for v in w]), F.col("pos") + 1)
    return pull.groupBy("pos").agg(F.sum(F.col("e") * F.col("x")).alias("g")).select("pos", F.abs(F.round(F.col("g") + own, 3)).alias("gradient"))


_INTERLEAVED = f"kn AS (SELECT node, CAST(ind AS DOUBLE) AS ind, row_number() OVER (PARTITION BY ind ORDER BY {DEAL.format(s=123)}, node) AS turn FROM feats WHERE ind IS NOT NULL), taken AS (SELECT node, ind FROM kn ORDER BY turn, ind DESC LIMIT 100)"


@query(f"WITH {FEATURES}, {_INTERLEAVED} SELECT node, ind, CAST(0 AS DOUBLE) AS gradient FROM taken")
def loo_logreg(f: Fixtures) -> DataFrame:
    """The held-out seeds, and for each the largest entry of the gradient, over all other seeds, of the model that left
    it out: 0 at its optimum."""
    seeds = materialise(f.features().where("ind is not null"))
    held = materialise(evaluate.interleaved(seeds, 100, 123))
    found = models.left_out_weights(seeds, held)
    table = f.spark.createDataFrame([(int(n), float(y), w.tolist()) for n, y, _, w in found], "fold long, label double, w array<double>")
    x = F.concat("features", F.array(F.lit(1.0)))
    pairs = seeds.crossJoin(F.broadcast(table)).where("node <> fold").select("fold", "label", "w", x.alias("x"), "ind")  # at most 100 models
    score = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    pull = pairs.select("fold", "label", "w", (models.sigmoid(score) - F.col("ind")).alias("e"), F.posexplode("x").alias("pos", "v"))
    sums = pull.groupBy("fold", "label", "pos").agg(F.sum(F.col("e") * F.col("v")).alias("g"), F.first(F.get("w", F.col("pos"))).alias("own"))
    return sums.groupBy(F.col("fold").alias("node"), F.col("label").alias("ind")).agg(F.round(F.max(F.abs(F.col("g") + F.col("own"))), 4).alias("gradient"))


_nominated("logreg")
_nominated("randfor", trees=Config().num_trees)
_nominated("boost", rounds=Config().num_trees)


# --- spectra -------------------------------------------------------------------------------------------------

SCREE = f"{FREQ}, scree AS (SELECT row_number() OVER (ORDER BY freq DESC, val) AS k, CAST(freq AS DOUBLE) AS x FROM freq WHERE type = 'word')"


@query(f"""WITH {SCREE}, pre AS (SELECT k, count(*) OVER () AS n, sum(x) OVER w AS s, sum(x * x) OVER w AS q, sum(x) OVER () AS ts, sum(x * x) OVER () AS tq FROM scree WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING)),
  sp AS (SELECT k, n, q - s * s / k AS l, (tq - q) - (ts - s) * (ts - s) / (n - k) AS r FROM pre WHERE k < n),
  va AS (SELECT k, n, l + r AS t, (k * l + (n - k) * r) / (n - 2) AS v FROM sp)
  SELECT CAST(k AS INTEGER) AS k, round(-t / (2 * v) - 0.5 * n * ln(2 * pi() * v), 6) AS ll FROM va""")
def elbow_profile(f: Fixtures) -> DataFrame:
    ranked = Attributes(f.attributes(), ("word",)).ranked(None)
    scree = ranked.select((F.col("rank") + 1).alias("k"), F.col("freq").cast("double").alias("x"))
    return spectral.elbow_profile(scree).select("k", r6("ll"))


_PROFILE = """pre{0} AS (SELECT k, count(*) OVER () AS n, sum(x) OVER w AS s, sum(x * x) OVER w AS q, sum(x) OVER () AS ts, sum(x * x) OVER () AS tq FROM scree{0} WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING)),
  sp{0} AS (SELECT k, n, q - s * s / k AS l, (tq - q) - (ts - s) * (ts - s) / (n - k) AS r FROM pre{0} WHERE k < n),
  va{0} AS (SELECT k, n, l + r AS t, (k * l + (n - k) * r) / (n - 2) AS v FROM sp{0}),
  el{0} AS (SELECT k FROM va{0} ORDER BY -t / (2 * v) - 0.5 * n * ln(2 * pi() * v) DESC, k LIMIT 1)"""


@query(f"""WITH {SCREE}, {_PROFILE.format('')}, scree2 AS (SELECT k - (SELECT k FROM el) AS k, x FROM scree WHERE k > (SELECT k FROM el)), {_PROFILE.format('2')}
  SELECT 1 AS which, CAST(k - 1 AS BIGINT) AS elbow FROM el UNION ALL SELECT 2, CAST((SELECT k FROM el) + k - 1 AS BIGINT) FROM el2""")
def elbow_choice(f: Fixtures) -> DataFrame:
    ranked = Attributes(f.attributes(), ("word",)).ranked(None)
    return spectral.elbow_table(ranked.select((F.col("rank") + 1).alias("k"), F.col("freq").cast("double").alias("x")), 2)


#: Leading pairs that the registered spectral queries ask for, and how far they may be off (of each value): the second to
#: the eighth stand close together at the edge of the others, and a run's default would ask for one part in n.
EIGENPAIRS, EIGEN_TOL = 8, 1e-3


def _adjacency_pairs(f: Fixtures, k: int = EIGENPAIRS, tol: float = EIGEN_TOL):
    """The adjacency's operator, and its leading pairs by the solver that embeddings use."""
    op = algebra.adjacency(f.edges())
    values, vectors = spectral.eigenpairs(op, k, f.spark, tol=tol, ones=k == 1)
    return op, values, vectors


@query()
def spectral_eigenvalues(f: Fixtures) -> DataFrame:
    return spectral.scree(_adjacency_pairs(f)[1], f.spark)


@query(f"SELECT CAST(unnest(range(1, {EIGENPAIRS + 1})) AS INTEGER) AS rank, CAST(0 AS DOUBLE) AS residual, CAST(1 AS DOUBLE) AS length")
def eigenpair_residuals(f: Fixtures) -> DataFrame:
    """Of each leading pair of the adjacency: how far A v lies from its value times v, against the largest value, and
    the length of v. What an exact pair gives is known: 0 and 1."""
    op, values, vectors = _adjacency_pairs(f)
    vectors = materialise(vectors)
    scale = F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("col") + 1).cast("int"))
    both = op.apply(vectors, EIGENPAIRS).select("id", "col", F.col("x").alias("ax")).join(vectors, ["id", "col"], "full")
    off = F.coalesce("ax", F.lit(0.0)) - scale * F.coalesce("x", F.lit(0.0))
    found = both.groupBy("col").agg(F.sqrt(F.sum(off * off)).alias("r"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    return found.select((F.col("col") + 1).cast("int").alias("rank"), F.abs(F.round(F.col("r") / abs(float(values[0])), 3)).alias("residual"), F.round("l", 6).alias("length"))


#: Steps of the power iteration that finds the leading pair in SQL; the second value is a fifth of the first.
POWERS = 24


def _power_sql() -> str:
    step = "p{k} AS MATERIALIZED (SELECT i, x / max(abs(x)) OVER () AS x FROM (SELECT adj.i, sum(v * p.x) AS x FROM adj JOIN p{b} p ON adj.j = p.i GROUP BY adj.i))"
    return ", ".join(["p0 AS (SELECT node AS i, CAST(1 AS DOUBLE) AS x FROM verts)", *[step.format(k=k + 1, b=k) for k in range(POWERS)]])


@query(f"""WITH {GRAPH}, {_power_sql()},
  ax AS (SELECT adj.i, sum(v * x) AS y FROM adj JOIN p{POWERS} p ON adj.j = p.i GROUP BY adj.i),
  val AS (SELECT sum(x * y) / sum(x * x) AS l, sqrt(sum(x * x)) AS len FROM ax JOIN p{POWERS} p ON ax.i = p.i)
  SELECT i AS id, round(x / len, 6) AS x, round(l, 4) AS value FROM p{POWERS}, val""")
def leading_pair(f: Fixtures) -> DataFrame:
    """The adjacency's largest value and its vector, whose entries are all of one sign."""
    _, values, vectors = _adjacency_pairs(f, 1, 1e-8)
    return vectors.where("col = 0").select("id", r6("x"), F.lit(round(float(values[0]), 4)).alias("value"))


#: Powers whose traces are compared: low ones weigh all values, high ones the leading.
TRACES = (1, 2, 3, 4, 8)
_BRAND = f"""{NODES}, {EDGES}, {ATTRS}, bv AS (SELECT node, val FROM attrs WHERE type = 'brand'),
  bs AS (SELECT DISTINCT val FROM bv), bi AS (SELECT val, row_number() OVER (ORDER BY val) - 1 AS k FROM bs),
  bp AS (SELECT x.k AS i, y.k AS j FROM edges JOIN bv s ON src = s.node JOIN bv d ON dst = d.node JOIN bi x ON s.val = x.val JOIN bi y ON d.val = y.val),
  bm AS (SELECT i, j, CAST(count(*) AS DOUBLE) AS v FROM (SELECT i, j FROM bp UNION ALL SELECT j, i FROM bp WHERE i <> j) GROUP BY i, j),
  m1 AS (SELECT i, j, v / (SELECT max(v) FROM bm) AS v FROM bm)"""
_PRODUCT = "m{0} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM m{1} a JOIN m{2} b ON a.j = b.i GROUP BY a.i, b.j)"


@query(f"""WITH {_BRAND}, {_PRODUCT.format(2, 1, 1)}, {_PRODUCT.format(3, 2, 1)}, {_PRODUCT.format(4, 2, 2)}, {_PRODUCT.format(8, 4, 4)},
  tr AS ({' UNION ALL '.join(f'SELECT {p} AS power, sum(v) AS t FROM m{p} WHERE i = j' for p in TRACES)})
  SELECT power, round(t / pow((SELECT t FROM tr WHERE power = 2), power / 2.0), 6) AS trace, true AS leads FROM tr""")
def spectrum_traces(f: Fixtures) -> DataFrame:
    """All pairs but one of the counts of brands along edges. The last value is what is missing from the trace; sums of
    powers with it equal the traces of the matrix's powers, which no other values give, and it is the least in
    magnitude, so that those found lead."""
    brands = f.values("brand")
    index = materialise(cooccur.numbered(brands.select("val").distinct(), "val", "idx"))
    named = brands.join(index, "val").select("node", "idx")
    ends = f.edges().join(named.select(F.col("node").alias("src"), F.col("idx").alias("i")), "src").join(named.select(F.col("node").alias("dst"), F.col("idx").alias("j")), "dst")
    counts = materialise(graph.symmetrize(ends.select("i", "j", F.lit(1.0).alias("v"))))
    n, most = index.count(), counts.agg(F.max("v")).first()[0]
    matrix = counts.select("i", "j", (F.col("v") / most).alias("v"))
    values, _ = spectral.eigenpairs(algebra.sparse((n, n), matrix, True), n - 1, f.spark, tol=1e-9)
    last = (matrix.where("i = j").agg(F.sum("v")).first()[0] or 0.0) - values.sum()
    every = [*values.tolist(), last]
    size = sum(v * v for v in every)
    rows = [(p, round(float(sum(v**p for v in every) / size ** (p / 2)), 6), bool(abs(last) <= np.abs(values).min() + 1e-9)) for p in TRACES]
    return f.spark.createDataFrame(rows, "power int, trace double, leads boolean")


@query()
def content_eigenvalues(f: Fixtures) -> DataFrame:
    """Leading eigenvalues of the node similarity by a type's values, matrix-free."""
    from .embeddings import node_operator

    values, _ = spectral.eigenpairs(node_operator(f.edges(), f.values("ptype"), f.nodes(), "NPMI1s", 0.0), 3, f.spark)
    return spectral.scree(values, f.spark)


@query(f"WITH {LONG} SELECT round(sum(v), 6) AS total_variance, CAST(count(*) AS INTEGER) AS components FROM (SELECT var_samp(x) AS v FROM long GROUP BY pos)")
def pca_total_variance(f: Fixtures) -> DataFrame:
    """All components together explain the whole variance."""
    values, _ = features.pca(f.features(), 64, 64)
    return f.spark.createDataFrame([(round(float(values.sum()), 6), len(values))], "total_variance double, components int")


@query()
def pca_variance(f: Fixtures) -> DataFrame:
    values, _ = features.pca(f.features(), 64, 10)
    return spectral.scree(values, f.spark)


# --- sources and sinks: written where the session's tables stand, and read back --------------------------------


def _folder(f: Fixtures) -> str:
    return f"{run_folder(f.spark)}/files-{uuid.uuid4().hex}"


@query(f"WITH {EDGES} SELECT src, dst, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY src, dst")
def edges_from_text(f: Fixtures) -> DataFrame:
    folder = _folder(f)
    f.edges().select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(folder)
    return readers.read_edges(f.spark, folder).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {ATTRS} SELECT node, type AS \"attributeType\", val AS \"attributeVal\" FROM attrs WHERE type IN ('brand', 'word', 'size')")
def attributes_from_csv(f: Fixtures) -> DataFrame:
    folder = _folder(f)
    f.attributes().write.option("sep", ";").option("header", True).csv(folder)
    return readers.read_attributes(f.spark, folder, ("brand", "word", "size"))


@query(f"""WITH {FREQ}, known AS (SELECT type, count(DISTINCT node) AS total_known FROM attrs WHERE {IN_KINDS} GROUP BY type)
  SELECT val AS attribute, freq.type AS "attributeType", freq, total_known AS "totalKnown", round(freq / sum(freq) OVER (PARTITION BY freq.type), 6) AS "relativeFreq", CAST(row_number() OVER w AS BIGINT) AS rank,
    round(sum(freq) OVER (w ROWS UNBOUNDED PRECEDING) / sum(freq) OVER (PARTITION BY freq.type), 6) AS percentile
  FROM freq JOIN known ON freq.type = known.type WINDOW w AS (PARTITION BY freq.type ORDER BY freq DESC, val)""")
def selected_from_csv(f: Fixtures) -> DataFrame:
    folder = _folder(f)
    stats = Attributes(f.attributes(), KINDS).selected_stats().select(F.col("val").alias("attribute"), F.col("type").alias("attributeType"), "freq", F.col("total_known").alias("totalKnown"), F.col("relative_freq").alias("relativeFreq"), "rank", "percentile")
    stats.write.option("header", True).option("escape", '"').csv(folder)
    return readers.read_selected(f.spark, folder).withColumns({"relativeFreq": r6("relativeFreq"), "percentile": r6("percentile")})


@query(f"WITH {FREQ}, k AS (SELECT unnest(['csv', 'parquet']) AS extension) SELECT extension, type, val, freq FROM freq, k")
def objects_saved_and_loaded(f: Fixtures) -> DataFrame:
    folder, freq = _folder(f), Attributes(f.attributes(), KINDS).frequencies().select("type", "val", "freq")
    out = []
    for extension in ("csv", "parquet"):
        writers.save_object(freq, folder, "freq", extension)
        loaded = readers.load_object(f.spark, folder, "freq", extension)
        out.append(loaded.select(F.lit(extension).alias("extension"), "type", "val", F.col("freq").cast("long").alias("freq")))
    return out[0].unionByName(out[1])


@query(f"WITH {FEATURES} SELECT node, CAST(len(embedding) AS INTEGER) AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM feats")
def embedding_cached(f: Fixtures) -> DataFrame:
    cache, key = writers.EmbeddingCache(f.spark, _folder(f)), writers.embedding_key("adj", 64)
    cache.put(key, f.features().select("node", "features"))
    return cache.get(key).select("node", F.size("features").alias("width"), F.round(F.get("features", F.lit(0)), 6).alias("first"))


@query(f"""WITH {GRAPH}, {_power_sql()} SELECT 0 AS line, printf('%.6f', sum(p.x * y) / sum(p.x * p.x)) AS value
  FROM (SELECT adj.i, sum(v * x) AS y FROM adj JOIN p{POWERS} p ON adj.j = p.i GROUP BY adj.i) ax JOIN p{POWERS} p ON ax.i = p.i""")
def eigenvalues_dumped(f: Fixtures) -> DataFrame:
    """The adjacency's largest value as the dump has it."""
    path = f"{_folder(f)}/eigvals.csv"
    writers.save_eigenvalues(f.spark, list(_adjacency_pairs(f, 1, 1e-8)[1]), path)
    text = f.spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line", "value"))


@query(f"""WITH {SCORED} SELECT CAST(row_number() OVER (ORDER BY prob DESC, node) - 1 AS INTEGER) AS line, node FROM sc""")
def ranked_as_tsv(f: Fixtures) -> DataFrame:
    path = f"{_folder(f)}/ranked.out"
    writers.save_ranked(_scored(f).orderBy(F.desc("prob"), "node"), path)
    text = f.spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value")).where("line > 0 and value <> ''")
    return text.select((F.col("line") - 1).alias("line"), F.split("value", "\t")[0].cast("long").alias("node"))


@query(f"SELECT rank, mean_prec, round(least(1.0, 1.1 * max(mean_prec) OVER ()), 6) AS highest FROM ({_MC_CURVE})")
def precision_saved(f: Fixtures) -> DataFrame:
    """The resampled curve as its file has it, with the upper end of its plot."""
    path = f"{_folder(f)}/precision.csv"
    writers.save_precision(mc_precision_curve(f), path)
    again = readers.read_precision(f.spark, path)
    return again.select("rank", r6("mean_prec"), F.round(F.lit(evaluate.highest(again)), 6).alias("highest"))
