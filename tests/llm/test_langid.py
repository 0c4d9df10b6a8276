"""Language identification against a plain version of all of it: grams, counts, priors, posteriors."""

import collections
import math
import zlib

import pytest
from graphnom.llm import langid as L
from graphnom.llm import queries
from graphnom.llm import textkit as K

from .plain import MASK, mixed


def grams(text):
    """Buckets of all one-, two- and three-character grams around a letter, and how many letters there are."""
    letters = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else "" for c in text or ""]
    codes = [0, *(ord(c) if c else 0 for c in letters), 0]
    out, n = collections.Counter(), 0
    for before, own, after in zip(codes, codes[1:], codes[2:]):  # noqa: B905
        if own:
            n += 1
            for order, key in ((1, own), (2, own + (before << 21)), (3, own + (before << 21) + (after << 42))):
                out[mixed((key + order * K.BASE) & MASK) >> 49] += 1
    return out, n


def plain_training(rows):
    """rows: (text, lang). Log-probabilities by language and bucket, the one of a bucket never seen, log priors."""
    counts, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        if text is not None and lang is not None:
            counts[lang].update(grams(text)[0])
            docs[lang] += 1
    every = sum(docs.values()) + len(docs)
    model = {}
    for lang in sorted(docs):
        total = counts[lang].total() + 0.5 * 32768
        model[lang] = ({b: math.log((n + 0.5) / total) for b, n in counts[lang].items()}, math.log(0.5 / total), math.log((docs[lang] + 1) / every))
    return model


def plain_posterior(model, text):
    found, n = grams(text)
    if not n or not model:
        return {"und": 0.0}
    total = {lang: prior + sum(k * logs.get(b, unseen) for b, k in found.items()) for lang, (logs, unseen, prior) in model.items()}
    most = max(total.values())
    odds = {lang: math.exp(t - most) for lang, t in total.items()}
    return {lang: o / sum(odds.values()) for lang, o in odds.items()}


def same(row, posterior):
    assert row.lang_pred in posterior
    assert row.score == pytest.approx(posterior[row.lang_pred], abs=1e-3)
    assert posterior[row.lang_pred] >= max(posterior.values()) - 1e-6


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in docs}
    model = plain_training((r.text, r.lang) for k, r in docs.items() if not held[k])
    got = queries.op5_language_id(spark, folder).collect()
    assert {r.doc_id: r.held_out for r in got} == held
    for r in got:
        same(r, plain_posterior(model, docs[r.doc_id].text))


def test_awkward_texts_in_several_batches(spark, monkeypatch):
    rows = [(k, f"{'wort' if k % 2 else 'mot'} {k} ÀÉß İǅ 漢字" * (k % 5), "de" if k % 2 else "fr") for k in range(90)]
    rows += [(100, None, "de"), (101, "", "fr"), (102, "12 !?", "fr"), (103, "wort", None), (104, "Wort\x00mot", "xx"), (105, "mot " * 400_000, "fr"), (None, "mot", "fr"), *rows[:7]]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, _text string, score int")
    monkeypatch.setattr(L, "HELD", 1)  # counts are handed on after each batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        names, logs, prior = L.train(docs)
        got = L.identify(docs, (names, logs, prior), keep=("doc_id", "_text", "text")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    model = plain_training((t, lang) for _, t, lang in rows)
    assert names == list(model)
    for k, (own, unseen, first) in enumerate(model.values()):
        assert prior[k] == pytest.approx(first)
        assert all(logs[b, k] == pytest.approx(own.get(b, unseen), abs=1e-5) for b in range(L.BUCKETS))
    assert len(got) == len(rows)
    for r in got:
        if len(r.text or "") < 1000:  # single-precision logarithms: long sums are told by their winner
            same(r, plain_posterior(model, r.text))
    assert next(r for r in got if r.doc_id == 105).lang_pred == "fr"


def test_too_many_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGUAGES", 3)
    docs = spark.createDataFrame([(f"text {k}", f"l{k}") for k in range(4)], "text string, lang string")
    with pytest.raises(ValueError, match="more than 3 languages"):
        L.train(docs)
    assert L.train(docs.where("lang <> 'l3'"))[0] == ["l0", "l1", "l2"]
