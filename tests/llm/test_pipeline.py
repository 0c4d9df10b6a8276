"""The pipeline on the smallest tables, on awkward ones, and against a brute-force version."""

import collections
import hashlib
import itertools
import random

import corpus_pipeline
import numpy as np
import sentencepiece
from graphnom.llm import common as C
from graphnom.llm import near_dedup, pieces, secret_scan

from . import plain

FOLDER = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = C.table(spark, FOLDER, "documents").cache()
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = C.materialise(stage(spark, docs, FOLDER))
        seen[name] = docs
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scans", "mix_sources", "tokenize"]
    kept, unique = seen["quality_rules"], seen["near_dedup"]
    assert 0 < unique.count() <= kept.count() < C.table(spark, FOLDER, "documents").count()
    assert unique.select("text").distinct().count() == unique.count()
    assert seen["secret_scans"].count() == unique.count()
    assert seen["secret_scans"].where("text rlike '(token|secret) = \"[0-9a-f]{24,}'").count() == 0
    assert docs.where("not round_trip").count() == 0
    again = corpus_pipeline.run(spark, FOLDER)
    digest = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.select("doc_id", "ids_sha256").collect())
    assert digest(again) == digest(docs)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, _doc string, kept string, _key_id string, size string"
KEY = "Abcdefghijklmnopqrstuvwxyz0123456789"


def documents():
    """Good and bad texts, near and exact copies, secrets, nulls, repeated rows, and columns that clash."""
    rnd = random.Random(12)
    good, bad = [f"{a}{b}" for a in ("ba", "ke", "li", "no") for b in ("ra", "ten", "mos", "vil", "du")], "buy now click here cheap offer win prize".split()
    some = lambda words, n: " ".join(rnd.choice(words) + rnd.choice(["", "", ".", "s"]) for _ in range(n))
    out = []
    for k in range(50):
        out.append((k, some(good, rnd.randint(60, 160)), "en", "abc"[k % 3]))
    for k in range(50, 80):
        out.append((k, some(good[:3] + bad, rnd.randint(60, 160)), "en", "abc"[k % 3]))
    for k in range(8):  # near copies: one word changed, which leaves them above the threshold
        words = out[k][1].split(" ")
        words[len(words) // 2] = "changed"
        out.append((100 + k, " ".join(words), "de", "b"))
    out += [(120 + k, out[k][1], "fr", None) for k in range(8, 14)]
    out += [(140 + k, some(good, 70) + f" token = {KEY[: 20 + k]} and AKIAABCDEFGHIJKL{k:04d} " + KEY + (str(k) if k % 4 == 3 else ""), "en", f"s{k}") for k in range(8)]
    out += [(200, None, None, None), (201, "", "en", "a"), (202, " \\n", None, "b"), (203, "short text", "en", "c"), (None, some(good, 90), "en", "a"), (None, some(good, 80), None, None), (7, some(good, 75), "en", "a")]
    out += [out[20], out[20], out[-2]]
    return [(*r, len(r[1] or ""), "clash", "clash", "clash", "clash") for r in out]


def plain_run(data, good, bad):
    """The rows (doc_id, text) that are left before mixing, with their sources, and how they must be mixed."""
    kept = [r for r, keep in zip(data, plain.quality_verdicts([(r[0], r[1]) for r in data], good, bad)) if keep]
    sets = [plain.shingles(r[1]) for r in kept]
    parent = list(range(len(kept)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(kept)), 2):
        if sets[i] == sets[j] or plain.similarity(sets[i], sets[j]) >= near_dedup.THRESHOLD:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = collections.defaultdict(list)
    for i, r in enumerate(kept):
        groups[root(i)].append(r)
    return kept, list(groups.values())


def test_run_against_a_brute_force_version(spark, tmp_path):
    data = documents()
    good, bad = list(range(0, 40)), list(range(50, 70))
    folder = str(tmp_path)
    spark.createDataFrame(data, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, q, 0) for q, ids in ((1, good), (0, bad)) for k in ids], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = C.table(spark, folder, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = C.materialise(stage(spark, docs, folder))
        seen[name] = docs
    rows = {name: df.collect() for name, df in seen.items()}
    for name in list(rows)[:-1]:
        assert seen[name].columns == C.table(spark, folder, "documents").columns and {r["_doc"] for r in rows[name]} == {"clash"}
    kept, groups = plain_run(data, good, bad)
    digest = lambda found: sorted((str(r[0]), r[1] or "", str(r[3])) for r in found)
    assert digest(rows["quality_rules"]) == digest(kept) and 60 < len(kept) < 90
    # one of each group stays, of the least id
    last = 1 << 62
    left = {(r.doc_id, r.text): r for r in rows["near_dedup"]}
    assert len(rows["near_dedup"]) == len(groups) == len(left)
    for members in groups:
        least = min(last if m[0] is None else m[0] for m in members)
        assert sum((m[0], m[1]) in left and (last if m[0] is None else m[0]) == least for m in {m[:2]: m for m in members}.values()) == 1
    # values are replaced by marks: live ones of one owner, examples of many
    owners, places = collections.defaultdict(set), collections.defaultdict(set)
    for r in left.values():
        for *_, value in plain.all_spans(r.text):
            owners[value].add(r.source)
            places[value].add(r.doc_id)
    want = {}
    for (k, text), r in left.items():
        spans = [(e - len(v), e, len(owners[v]) < secret_scan.EXAMPLE_OWNERS or len(places[v]) < secret_scan.EXAMPLE_REPOSITORIES, kind) for _, kind, e, v in plain.all_spans(text)]
        new, at = "", 0
        for a, b, live, kind in sorted(s for s in spans if s[3] < 3 or s[2]):
            if b > at:
                new += text[at : max(a, at)] + ("<SECRET>" if live else "<EXAMPLE>")
                at = b
        want[k, r.source, new + text[at:]] = r
    assert {(r.doc_id, r.source, r.text) for r in rows["secret_scans"]} == set(want) and all(r.n_chars == len(r.text) for r in rows["secret_scans"])
    assert any("<SECRET>" in t for *_, t in want) and any(KEY in t for *_, t in want)
    # each source's words come as near its target as whole documents can
    sizes = {x: len(plain.words(x[2])) for x in want}
    total = collections.Counter()
    for x, n in sizes.items():
        total[x[1]] += n
    target = plain.targets(total)
    times = collections.Counter((r.doc_id, r.source, r.text) for r in rows["mix_sources"])
    for source in total:
        own = [x for x in want if x[1] == source]
        full = min(int(target[source] // total[source]), 2)
        assert {times[x] for x in own} <= {full, full + 1} and max(times[x] for x in own) <= 2
        sums = {0}
        for x in own if full < 2 else []:
            sums |= {s + sizes[x] for s in sums}
        taken = sum(times[x] * sizes[x] for x in own)
        assert abs(taken - target[source]) <= min(abs(full * total[source] + s - target[source]) for s in sums) + 1
    library = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    ids = collections.Counter()
    for x, n in times.items():
        ids[x[0], x[1], hashlib.sha256(np.array(library.encode(x[2]), "<i4").tobytes()).hexdigest()] += n
    assert collections.Counter((r.doc_id, r.source, r.ids_sha256) for r in rows["tokenize"]) == ids and all(r.round_trip for r in rows["tokenize"])
    again = corpus_pipeline.run(spark, folder)
    assert collections.Counter((r.doc_id, r.source, r.ids_sha256) for r in again.collect()) == ids


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
