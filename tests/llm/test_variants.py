"""Spelling variants: automata against sorted lists, near words against all pairs, the query against a plain version."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from graphnom.llm import variants as W


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def some_words(rnd, n, letters="ab", low=6, high=11):
    return sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(low, high))) for _ in range(n)})


def test_automaton_is_minimal_and_numbers_its_words():
    rnd = random.Random(1)
    for _ in range(30):
        words = some_words(rnd, rnd.choice([0, 1, 5, 200]), "abcé", 1, 7)
        automaton = W.Automaton(words)
        for k, word in enumerate(words):
            at, number = automaton.root, 0
            for sign in word:
                at, more = automaton.edges[at][sign]
                number += more
            assert automaton.final[at] and number == k
        assert automaton.size[automaton.root] == len(words)
        # as many states as there are different sets of endings
        endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)} | {""}}
        assert len(automaton.size) == len(endings)
        for word in [*words[:20], "abc", ""]:
            for exact in {0, len(word) // 2, len(word)}:
                found = [words[k] for k in automaton.near(word, exact)]
                assert len(found) == len(set(found))
                assert set(found) == {v for v in words if one_edit(word, v) and v[:exact] == word[:exact]}


def plain_variants(counts):
    """By shared deletions: words are near if one is the other without a sign, or both lose the same place."""
    by_gap = defaultdict(set)
    for w in counts:
        by_gap[w].add(w)
        for k in range(len(w)):
            by_gap[w[:k] + w[k + 1 :]].add(w)
    near = {w: set() for w in counts}
    for group in by_gap.values():
        for a in group:
            near[a] |= {b for b in group - near[a] if one_edit(a, b)}
    out = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        out[w] = [form, w, n, len(near[w]), counts[form] if form is not None else None]
    for w, row in out.items():
        while out[row[1]][0] is not None:
            row[1] = out[row[1]][0]
        assert row[0] is not None or row[1] == w
    return {w: tuple(row) for w, row in out.items()}


@pytest.mark.parametrize(("cell", "group"), [(20_000, 20_000), (4, 50), (1, 1)])
def test_near_words_against_all_pairs(spark, monkeypatch, cell, group):
    monkeypatch.setattr(W, "CELL", cell)
    rnd = random.Random(cell)
    words = some_words(rnd, 250) + some_words(rnd, 150, "abcdefé", 6, 7) + ["z" * 6, "z" * 7, "z" * 8, "zzzzzzy", "y" + "z" * 6] + ["same" * 3 + c for c in "abcdefghij"]
    counts = {w: rnd.choice([5, 5, 6, 25, 30, 125, 626, 4000]) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    # the searches themselves, in groups of every size
    rows = sorted((r.cell, r.length, r.begins, r.ends, r.word, r.n) for r in W.cells(table).collect())
    assert max(Counter(r[0] for r in rows if r[1] - r[2] - r[3] > 1).values(), default=0) <= cell
    monkeypatch.setattr(W, "GROUP", group)
    found = Counter()
    import pyarrow as pa

    columns = [pa.array(c) for c in zip(*rows, strict=True)]
    for batch in W.search(iter([pa.RecordBatch.from_arrays(columns, ["cell", "length", "begins", "ends", "word", "n"])])):
        for word, near in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found[word] += near
    assert found == Counter({w: n for w in words if (n := sum(one_edit(w, v) for v in words))})
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in W.variants(table).collect()}
    assert out == plain_variants(counts)


def plain_vocabulary(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_awkward_texts(spark, monkeypatch):
    monkeypatch.setattr(W, "COUNTED", 3)
    rnd = random.Random(8)
    pool = ["Straße", "STRASSE", "Garçon", "garcon", "Letter", "letters", "lettre", "Ärztlich", "ärztlich", "x×y÷zz", "naïveté", "don't", "wörter", "ĀāĂă", "漢字漢字漢字"]
    rows = [(k, " ".join(rnd.choice(pool) for _ in range(30))) for k in range(80)]
    rows += [(None, "letter letter"), (1, None), (2, ""), (3, " \n"), *rows[:5]]
    rows += [(k, "a" * 200_000 + " " + "b" * 6 + " word" * 200_000) for k in range(900, 906)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in W.spelling_variants(docs).collect()}
    want = plain_vocabulary(rows)
    assert {w: r[2] for w, r in out.items()} == want
    assert {w: r for w, r in out.items() if len(w) < 100} == plain_variants({w: n for w, n in want.items() if len(w) < 100})
    assert W.spelling_variants(docs.where("false")).count() == 0


def test_query_over_the_whole_table(spark):
    from graphnom.llm import queries

    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op11_spelling_variants(spark, folder).collect()}
    assert out == plain_variants(plain_vocabulary(rows))
    assert any(r[0] is not None for r in out.values())
