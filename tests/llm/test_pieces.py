"""Streaming Viterbi: against the library, every segmentation, and plain following of all ways; decoding."""

import random

import numpy as np
import pytest
import sentencepiece
from graphnom.llm import pieces as P

LETTERS = list(" abcdefghtheinr.,'\n\téü漢字😀0123<>/=_-   ")


@pytest.fixture(scope="module")
def model():
    return P.model_bytes()


def written(text):
    return P.SPACE + text.replace(" ", P.SPACE) if text else ""


def unigram(model):
    v = P.Vocabulary(model)
    v.pairs, v.scores = False, {"a": -1.0, "b": -1.2, "ab": -1.9, "ba": -1.7, "aab": -2.5, "bb": -3.0, "abba": -3.1}
    v.ids = {p: k for k, p in enumerate(v.scores)}
    v.index()
    return v


def test_ids_equal_the_library_and_come_back(model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    v = P.Vocabulary(model)
    encoder = P.Encoder(v)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += [c * n for c in ("a", " ", "ab", "\n", "the ", "0", "thequickbrown", "é漢") for n in (1, 2, 63, 64, 65, 500)] + ["", " ", "  ", " a", "a ", "a  b", "▁", " ▁"]
    for t in texts:
        ids = encoder.encode(t)
        assert ids.tolist() == library.encode(t), t
        assert P.decode(v, ids) == t.replace(P.SPACE, " ")
        assert list(encoder.stream(written(t))) == encoder.merged(written(t))  # the window, without what is remembered


def test_pairs_are_told_by_halves(model):
    """Without merging their joint text, and equal to it; by merging it where scores do not fall."""
    rnd = random.Random(10)
    encoder = P.Encoder(P.Vocabulary(model))
    merged, asked = encoder.merged, []
    encoder.merged = lambda text: asked.append(text) or merged(text)
    encoder.encode(" ".join("".join(rnd.choice("aeinrst") for _ in range(rnd.randint(4, 14))) for _ in range(300)))
    assert len(encoder.allowed) > 500 and not asked
    pieces = list(encoder.v.ids)
    pairs = [(rnd.choice(pieces), rnd.choice(pieces)) for _ in range(4000)] + [(p, p) for p in pieces[:2000]]
    pairs += [(p[:k], p[k:]) for p in pieces[:4000] for k in range(1, len(p)) if p[:k] in encoder.v.ids and p[k:] in encoder.v.ids]
    pairs += list(encoder.allowed)
    assert all(encoder.pair(a, b) == (merged(a + b) == [a, b]) for a, b in pairs) and not asked
    v = P.Vocabulary(model)
    for _ in range(60):
        v.scores = {"".join(rnd.choice("ab") for _ in range(rnd.randint(2, 5))): float(rnd.randint(-9, 0)) for _ in range(12)} | {"a": -20.0, "b": -21.0}
        v.ids = {p: k for k, p in enumerate(v.scores)}
        v.index()
        encoder = P.Encoder(v)
        for a in v.ids:
            for b in v.ids:
                assert encoder.pair(a, b) == (encoder.merged(a + b) == [a, b]), (a, b, v.scores)


def test_many_cuts_are_searched_side_by_side(model):
    """None of them one by one; ids as the library's, with long cuts, signs without a piece and runs of spaces among them."""
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rnd = random.Random(11)
    words = ["".join(rnd.choice("aeiouéthnrs") for _ in range(rnd.randint(1, 14))) for _ in range(4000)]
    encoder = P.Encoder(P.Vocabulary(model))
    one_by_one, asked = encoder.whole, []
    encoder.whole = lambda cut: asked.append(cut) or one_by_one(cut)
    text = " ".join(words)
    assert encoder.encode(text).tolist() == library.encode(text) and not asked
    assert encoder.searched == sum(map(len, {c for w in words for c in encoder.v.cut.findall(P.SPACE + w)}))
    texts = [" ".join("".join(rnd.choice(LETTERS) for _ in range(rnd.randint(1, 30))) for _ in range(200)) for _ in range(40)]
    texts += ["", " ", "\U0001f9ff", "a" * 500, "x\U0001f9ffy " * 3, text]
    encoder = P.Encoder(P.Vocabulary(model))
    assert [x.tolist() for x in encoder.encode_batch(texts)] == library.encode(texts) and encoder.tables is not None
    assert [encoder.encode(t).tolist() for t in texts] == library.encode(texts)


def test_pairs_are_told_side_by_side(model, monkeypatch):
    """As one by one, also where halves do not tell, and where pairs push each other out of their place."""
    monkeypatch.setattr(P, "JUDGED", 16)
    rnd = random.Random(12)
    v = P.Vocabulary(model)
    for _ in range(60):
        v.scores = {"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 5))): float(rnd.randint(-9, 0)) for _ in range(14)} | {"a": -20.0, "b": -21.0, "c": -21.0}
        v.ids = {p: k for k, p in enumerate(v.scores)}
        v.index()
        encoder = P.Encoder(v)
        tables = P.Tables(encoder)
        pairs = [(a, b) for a in v.ids for b in v.ids]
        for _ in range(2):
            got = tables.allowed(*np.array([(v.ids[a], v.ids[b]) for a, b in pairs]).T)
            assert got.tolist() == [encoder.merged(a + b) == [a, b] for a, b in pairs], v.scores
        while made := [p for p in v.ids if encoder.merged(p) != [p]]:  # no way goes over a piece that merging does not give
            for p in made:
                del v.ids[p], v.scores[p]
        v.index()
        tables = P.Tables(encoder := P.Encoder(v))
        cuts = list({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, v.longest))) for _ in range(50)} | {"d", "ad"[: v.longest]})
        for cut, ids in zip(cuts, tables.search(cuts), strict=True):
            assert (ids is None) == ("d" in cut)
            assert ids is None or np.frombuffer(ids, np.int32).tolist() == [v.ids[p] for p in encoder.merged(cut)]


def test_every_cut_goes_through_the_window(model):
    v = P.Vocabulary(model)
    encoder = P.Encoder(v)
    rnd = random.Random(6)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 90))) for _ in range(400))
    encoder.encode(text)
    cuts = {c for w in written(text).replace(P.SPACE, " " + P.SPACE).split(" ") for c in v.cut.findall(w)}
    assert encoder.searched == sum(map(len, cuts)) and max(map(len, cuts)) > P.REMEMBERED
    encoder.encode(text)  # short ones are remembered in front of it, long ones are searched again
    assert encoder.searched == sum(len(c) * (1 + (len(c) > P.REMEMBERED)) for c in cuts)


@pytest.mark.parametrize("pairs", [True, False])
def test_commits_as_soon_as_all_ways_meet(model, pairs):
    """After each character, what is committed is all before the boundary where the surviving ways, followed back one
    by one, meet."""
    v = P.Vocabulary(model) if pairs else unigram(model)
    encoder = P.Encoder(v)
    rnd = random.Random(7)
    for _ in range(20):
        text = "".join(rnd.choice("abba" if not pairs else "theinrsto") for _ in range(rnd.randint(30, 150)))
        steps = encoder.merge_steps if pairs else encoder.score_steps
        back, shown, done = {0: None}, {}, [0]

        def watched(text, last, total, back=back, shown=shown, done=done, steps=steps):
            at = 0
            for end in steps(text, last, total):
                for k in range(at + 1, end + 1):
                    if k in last:
                        back[k] = k - len(last[k])
                at = end
                yield end
                shown[end] = done[0]  # asked for again: what this place allows has been committed by now

        name = "merge_steps" if pairs else "score_steps"
        setattr(encoder, name, watched)
        out = []
        for piece in encoder.stream(text):
            out.append(piece)
            done[0] += len(piece)
        delattr(encoder, name)
        assert "".join(out) == text and shown
        for end, committed in shown.items():
            ways = []
            for k in range(max(0, end - v.longest + 1), end + 1):
                if k in back:
                    way = [k]
                    while back[way[-1]] is not None:
                        way.append(back[way[-1]])
                    ways.append(set(way))
            assert committed == max(set.intersection(*ways)), (text, end)


def test_the_window_does_not_grow(model):
    for v in (P.Vocabulary(model), unigram(model)):
        encoder = P.Encoder(v)
        rnd = random.Random(8)
        text = "".join(rnd.choice("ab") for _ in range(200_000))
        assert "".join(encoder.stream(text)) == text
        assert encoder.kept <= 8 * v.longest


def test_unigram_against_every_segmentation(model):
    v = unigram(model)
    encoder = P.Encoder(v)
    rnd = random.Random(2)
    for _ in range(100):
        t = "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 14)))
        best = {0: 0.0}
        for end in range(1, len(t) + 1):
            best[end] = max(best[k] + v.scores[t[k:end]] for k in range(end) if t[k:end] in v.scores)
        assert sum(v.scores[p] for p in encoder.stream(t)) == pytest.approx(best[len(t)])


def test_tables(spark, model):
    rnd = random.Random(9)
    texts = [None, "", " \n\t ", "x" * 300_000, "same text", "same text", "é 漢字 " * 3000] + ["".join(rnd.choice(LETTERS) for _ in range(200)) for _ in range(60)]
    frame = spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string, _text string").repartition(3)
    got = {r.doc_id: r for r in P.tokenize(frame, model, keep=("doc_id", "_text")).collect()}
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    for k, t in enumerate(texts):
        assert got[k].ids == library.encode(t or "") and got[k].n_ids == len(got[k].ids) and got[k].round_trip and got[k]["_text"] == "clash"
    assert got[4].ids_sha256 == got[5].ids_sha256
    assert P.tokenize(frame.limit(0), model).count() == 0
    assert P.model_bytes("file:///opt/tokenizers/piece_bpe_32k.model", spark) == model
