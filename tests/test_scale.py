"""What holds at scale: published cache versions, hubs dealt into parts, medians by shrinking ranges."""

import random
import statistics
from collections import Counter

import pytest
from graphnom.operators import cooccur, features
from graphnom.sources import readers, writers
from pyspark.sql import functions as F


def block(spark, n, value):
    return spark.range(n).select(F.col("id").alias("node"), F.array(F.lit(float(value))).alias("features"))


def test_readers_keep_their_version(spark, tmp_path):
    cache = writers.EmbeddingCache(spark, str(tmp_path))
    assert cache.get("k") is None
    cache.put("k", block(spark, 5, 1))
    held = cache.get("k")
    again = cache.put("k", block(spark, 7, 2))
    assert held.count() == 5 and {r.features[0] for r in held.collect()} == {1.0}  # while it was being read
    assert cache.get("k").count() == again.count() == 7
    # a cached frame can be made of what the cache holds
    cache.put("k", cache.get("k").union(held))
    assert cache.get("k").count() == 12 and len(cache.manifests("k")) == 3
    cache.prune("k")
    assert cache.get("k").count() == 12 and len(cache.manifests("k")) == 1


def test_a_writer_that_dies_leaves_the_last_version(spark, tmp_path, monkeypatch):
    cache = writers.EmbeddingCache(spark, str(tmp_path))
    cache.put("k", block(spark, 5, 1))
    with pytest.raises(Exception, match="."):
        cache.put("k", block(spark, 9, 2).withColumn("node", F.raise_error(F.lit("killed")).cast("long")))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(writers, "renamed", killed)  # written, but not yet published
        cache.put("k", block(spark, 9, 3))
    assert cache.get("k").count() == 5
    cache.put("k", block(spark, 6, 4))
    assert cache.get("k").count() == 6


def test_two_writers_publish_one_after_the_other(spark, tmp_path, monkeypatch):
    cache = writers.EmbeddingCache(spark, str(tmp_path))
    cache.put("k", block(spark, 5, 1))
    monkeypatch.setattr(cache, "manifests", lambda key: [])  # this one has not seen the other's
    cache.put("k", block(spark, 8, 2))
    monkeypatch.undo()
    assert cache.get("k").count() == 8 and cache.manifests("k") == ["manifest-000000001", "manifest-000000002"]
    assert readers.listing(spark, str(tmp_path / "none")) == []


def test_hubs_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "HUB", 40)
    rnd = random.Random(5)
    edges = [(0, k) for k in range(1, 400)] + [(k, 3) for k in range(4, 150)] + [(rnd.randint(1, 399), rnd.randint(1, 399)) for _ in range(600)]
    values = sorted({(k, f"v{(k * 7 + j) % 5}") for k in range(0, 400, 2) for j in range(k % 3)} | {(0, "hub"), (3, "in"), (3, "both")})
    e = spark.createDataFrame(edges, "src long, dst long")
    v = spark.createDataFrame(values, "node long, val string")
    of = {}
    for node, val in values:
        of.setdefault(node, []).append(val)
    want = Counter()
    for s, d in edges:
        for x in of.get(s, [f"*???*_{s}"]):
            for y in of.get(d, [f"*???*_{d}"]):
                want[min(x, y), max(x, y)] += 1
    assert {(r.a, r.b): r.c for r in cooccur.pair_counts(e, v).collect()} == want
    once = e.distinct()
    split = cooccur.hubs(once)
    assert {(r.side, r.node) for r in split.collect()} >= {("src", 0), ("dst", 3)}
    # a hub with a third of all edges: none of its parts is much larger than a hub may be
    parts = split.where("side = 'src' and node = 0").first().parts
    sizes = Counter(r.p for r in once.where("src = 0").select(F.pmod(F.xxhash64("dst"), F.lit(parts)).alias("p")).collect())
    assert parts == 10 and max(sizes.values()) < 3 * statistics.median(sizes.values())
    monkeypatch.setattr(cooccur, "HUBS", 1)
    assert {(r.a, r.b): r.c for r in cooccur.pair_counts(e, v).collect()} == want


def test_medians_by_shrinking_ranges(spark, monkeypatch):
    monkeypatch.setattr(features, "BINS", 4)
    rnd = random.Random(6)
    columns = {
        "odd": [rnd.uniform(-5, 5) for _ in range(31)],
        "even": [rnd.choice([1e-9, 2.0, 1e12, -3.5]) for _ in range(30)] + [None],
        "same": [7.0] * 31,
        "ties": [1.0] * 15 + [2.0] * 15 + [None],
        "none": [None] * 31,
        "wide": [10.0 ** (k - 15) for k in range(30)] + [float("nan")],
        "one": [None] * 30 + [4.0],
    }
    table = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns))
    got = features.medians(table, tuple(columns))
    for c, v in columns.items():
        known = [x for x in v if x is not None and x == x]
        assert got[c] == (statistics.median(known) if known else None), c
    assert features.medians(table.where("false"), ("odd",)) == {"odd": None}
    filled = features.impute(table.select("even"), ("even",), "median").where(F.col("even") == got["even"])
    assert filled.count() >= 1
