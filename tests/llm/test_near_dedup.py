"""Near-duplicate classes: what is compared where rows repeat, extreme texts, clashing columns."""

import random

from graphnom.llm import near_dedup as N
from graphnom.llm import common as C
from pyspark.sql import functions as F


def text(seed, n=120, edits=()):
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    for k in edits:
        words[k] = f"edit{k}"
    return " ".join(words)


def test_copies_are_compared_once(spark):
    """A thousand equal rows without ids of each of two near texts: as many rows are compared as there are pairs."""
    a, b = text(1), text(1, edits=(50,))
    docs = spark.createDataFrame([(None, t) for t in (a, b) for _ in range(1000)] + [(7, text(2))], "doc_id long, text string").repartition(8)
    source = docs.select("text", F.lit((1 << 63) - 1).alias("_id"))
    signed = C.arrow_map(source.select("text", "_id"), N._sign, "_id long, _node long, _bands array<long>")
    nodes = C.materialise(N.ranked(signed.groupBy("_node").agg(F.min("_id").alias("_id"), F.any_value("_bands").alias("_bands"))))
    assert nodes.count() == 3
    pairs = C.materialise(N.candidates(nodes).union(N.candidates(nodes, N.NARROW)).dropDuplicates(["a", "b"]))
    needed = pairs.select(F.col("a").alias("_node")).union(pairs.select(F.col("b").alias("_node"))).distinct()
    assert N.shingle_sets(needed, nodes, source).count() == needed.count() == 2
    compared = N.verified(pairs, nodes, source, N.THRESHOLD).collect()
    assert len(compared) == pairs.count() == 1 and compared[0].linked and compared[0].a < compared[0].b
    got = N.classes(docs, keep=("doc_id", "text")).groupBy("class_key").count().collect()
    assert sorted(r["count"] for r in got) == [1, 2000]


def test_defined_cases(spark):
    long = text(3, 60_000)
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "one two", "x"), (5, "one  two", "y"), (6, long, "x"), (7, long + " more", "x"), (8, text(4), "x"), (8, text(4), "x"), (None, text(4), "z"), (9, text(5), "x")]
    docs = spark.createDataFrame([(*r, "clash", {"k": "v"}) for r in rows], "doc_id long, text string, class_id string, _bands string, m map<string,string>").repartition(3)
    got = {}
    for r in N.classes(docs.select("doc_id", "text")).collect():
        got.setdefault(r.class_id, []).append(r.doc_id)
    assert {k: sorted(v, key=str) for k, v in got.items()} == {1: [1, 2, 3], 4: [4, 5], 6: [6, 7], 8: [8, 8, None], 9: [9]}
    left = N.survivors(docs)
    assert left.columns == docs.columns and sorted((r.doc_id, r.class_id, r.m["k"]) for r in left.collect()) == [(k, "y" if k == 5 else "x", "v") for k in (1, 4, 6, 8, 9)]
    assert N.survivors(docs.limit(0)).count() == 0


def test_classes_do_not_depend_on_how_rows_are_batched(spark):
    rows = [(k, text(9, 150, random.Random(k).sample(range(150), 2))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r.class_id for r in N.classes(docs.coalesce(1)).collect()}
    many = {r.doc_id: r.class_id for r in N.classes(docs.repartition(40, "doc_id")).collect()}
    assert one == many
