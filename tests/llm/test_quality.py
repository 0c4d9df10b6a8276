"""Quality rules: counts, ratio and threshold against plain versions."""

import collections
import math
import random
import re

import numpy as np
import pytest
from graphnom.llm import quality as Q
from pyspark.sql import functions as F

from .plain import buckets as plain_buckets

GOOD = "the of and river stone maple harbor north letter garden winter bridge summit".split()
BAD = "buy now click here cheap offer win prize bonus".split()


def rows():
    rnd = random.Random(3)
    some = lambda words, n: " ".join(rnd.choice(words) + rnd.choice(["", "", ".", "s"]) for _ in range(n))
    out = [(k, some(GOOD, rnd.randint(40, 120))) for k in range(60)] + [(100 + k, some(GOOD[:4] + BAD, rnd.randint(40, 120))) for k in range(60)]
    out += [(200, None), (201, ""), (202, " \n"), (203, "same line\nsame line\n\nother\nsame line " + "spam ham " * 60), (204, some(GOOD, 30_000)), (None, some(GOOD, 70)), (None, some(GOOD, 70)), (205, "é# 𝒳* " * 30), (7, some(GOOD, 60))]
    return out + [out[0], out[61]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows()], "doc_id long, text string, _text string, score string, _trusted string").repartition(4).cache()


def labels(spark, ids):
    return spark.createDataFrame([(k,) for k in ids], "doc_id long")


def test_against_a_plain_version(spark, docs):
    good, bad = [*range(30), None, 3], [*range(100, 130), 5000]
    got = Q.quality(docs, labels(spark, good), labels(spark, bad), keep=("doc_id", "text", "_trusted")).collect()
    data = rows()
    assert len(got) == len(data) and all(r["_trusted"] == "clash" for r in got)
    trusted = set(range(30))
    grams = [collections.Counter(plain_buckets(t)) for _, t in data]
    raw, target = collections.Counter(), collections.Counter()
    for (k, _), g in zip(data, grams):
        raw.update(g)
        if k in trusted:
            target.update(g)
    size, n_raw, n_target = Q.BUCKETS, raw.total() + Q.SMOOTHING * Q.BUCKETS, target.total()

    def plain_score(k, g):
        n, own = g.total(), k in trusted
        total = n_target - n * own
        share = total / (total + 2 * size)
        return sum(c * math.log(share * ((target[b] - c * own) / total) / ((raw[b] + Q.SMOOTHING - c) / (n_raw - n)) + 1 - share) for b, c in g.items()) / max(n, 1)

    def failed(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
        return len(w) < 50 or 100 * len(covered) > 50 * len(w), len(w), sum(map(len, w)), len(covered)

    scores = {(k, t): plain_score(k, g) for (k, t), g in zip(data, grams)}
    sides = [[scores[r] for r in data if r[0] in ids and not failed(r[1])[0]] for ids in (trusted, set(range(100, 130)))]
    limit = Q.parting(np.round(sides[0], 9), np.round(sides[1], 9))
    assert limit != Q.THRESHOLD
    for r in got:
        text = r.text or ""
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        base, n, chars, covered = failed(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, len(re.findall(r"[#*$%&|<>]", text)), dup, covered, base)
        assert r.score == pytest.approx(scores[r.doc_id, r.text], abs=1e-8)
        assert r.kept == (not base and r.score >= limit)
    # documents that no label names are parted too
    ends = {r.doc_id: r.kept for r in got if not r.base_failed}
    right = [kept == (k < 100) for k, kept in ends.items() if k in range(30, 60) or k in range(130, 160)]
    assert np.mean(right) > 0.9


def test_threshold_by_all_cuts():
    rnd = np.random.default_rng(2)
    for _ in range(30):
        good, bad = np.round(rnd.normal(1, 1, 25), 1), np.round(rnd.normal(-1, 1, 30), 1)
        cuts = sorted({*good, *bad})
        wrong = [(good < c).mean() + (bad >= c).mean() for c in cuts]
        got = Q.parting(good, bad)
        assert (good < got).mean() + (bad >= got).mean() == pytest.approx(min(wrong))
    assert Q.parting(good[:4], bad) == Q.THRESHOLD


def test_without_labels(spark, docs):
    none = labels(spark, [])
    assert Q.quality(docs, none).where("score <> 0 or kept <> (not base_failed and 0 >= -0.115)").count() == 0
    assert Q.quality(docs.limit(0), labels(spark, [1]), none).count() == 0
    assert Q.quality(docs, labels(spark, [1]), labels(spark, [100])).where(f"kept <> (not base_failed and score >= {Q.THRESHOLD})").count() == 0


def test_all_labels_count(spark, docs):
    """Of 400,000 labelled ids a few are documents: none of them is left out."""
    want = sorted(map(str, Q.quality(docs, labels(spark, range(30)), labels(spark, range(100, 130))).collect()))
    far = spark.range(10**6, 10**6 + 200_000).withColumnRenamed("id", "doc_id")
    got = Q.quality(docs, labels(spark, range(30)).unionByName(far), labels(spark, range(100, 130)).unionByName(far.selectExpr("doc_id + 1000000 as doc_id")))
    assert sorted(map(str, got.collect())) == want


def test_joined_labels_and_running_counts(spark, docs, monkeypatch):
    good, bad = labels(spark, [*range(30), None, 3, 110]), labels(spark, [*range(100, 130), 5000])
    want = sorted(map(str, Q.quality(docs, good, bad).collect()))
    named = [d.withColumn("doc_id", F.col("doc_id").cast("string")) for d in (docs, good, bad)]
    texts = sorted(map(str, Q.quality(*named).withColumn("doc_id", F.col("doc_id").cast("long")).collect()))
    monkeypatch.setattr(Q, "SENT_IDS", 0)
    monkeypatch.setattr(Q, "DRIVER_SCORES", 0)
    assert sorted(map(str, Q.quality(docs, good, bad).collect())) == want == texts


def test_parted_is_parting(spark, monkeypatch):
    monkeypatch.setattr(Q, "DRIVER_SCORES", 0)
    rnd = np.random.default_rng(4)
    for n in (60, 4):
        good, bad = np.round(rnd.normal(1, 1, n), 1), np.round(rnd.normal(-1, 1, 70), 1)
        rows = spark.createDataFrame([(True, float(v)) for v in good] + [(False, float(v)) for v in bad], "_good boolean, score double")
        assert Q.parted(rows) == Q.parting(good, bad)
