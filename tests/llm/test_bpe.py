"""Speculated and verified BPE: against the library, plain merging, and every pair of tokens of a small model; decoding."""

import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from graphnom.llm import bpe as B
from tokenizers import Tokenizer

POOL = list(" abcdefghtheinr.,'\n\té ü漢字😀0123<>/=_-   ՘֋\x1c\x85\xa0²Ⅷ\x00") + ["<|endoftext|>", "the", "ing", "'s", "  ", "'LL", "<|endof"]


@pytest.fixture(scope="module")
def model():
    return B.model_bytes()


@pytest.fixture(scope="module")
def library(model):
    return Tokenizer.from_str(model.decode())


@pytest.fixture(scope="module")
def encoder(model):
    return B.Encoder(B.Vocabulary(model))


def toy(merges):
    """A tokenizer of the 256 bytes and the given merges, as JSON."""
    signs = B.byte_signs()
    vocab = {s: k for k, s in enumerate(signs)}
    for a, b in merges:
        vocab[a + b] = len(vocab)
    model = {"type": "BPE", "dropout": None, "unk_token": None, "vocab": vocab, "merges": [list(m) for m in merges]}
    split = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    told = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None}
    return json.dumps(told | {"pre_tokenizer": split, "post_processor": None, "decoder": split, "model": model}).encode()


def plain_merge(v, word):
    parts = [bytes([b]) for b in word]
    while True:
        due = [(v.ranks[key][0], i) for i in range(len(parts) - 1) if (key := v.ids[parts[i]] * v.n + v.ids[parts[i + 1]]) in v.ranks]
        if not due:
            return [v.ids[p] for p in parts]
        _, i = min(due)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_ids_equal_the_library_and_come_back(library, encoder):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 80))) for _ in range(4000)]
    texts += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (47, 48, 49, 63, 64, 65, 5000)]
    texts += [c * n for c in ("a", " ", "ab", "\n", "the ", "<|endoftext|>", "é漢", " \n") for n in (1, 2, 3, 64, 65, 700)] + ["", "  a", "a  ", "\n  a", " \n a"]
    for t, got, want in zip(texts, encoder.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids, t
        assert B.decode(encoder.v, got) == library.decode(want.ids, skip_special_tokens=False) == t
    assert 0 < encoder.merged < encoder.proposed  # some words were right at once, some had to be merged


def test_every_sign_is_split_as_the_library_does(library, encoder):
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(signs), 5000):
        text = "".join(f"a{c}a1{c}1!{c}! {c} " for c in signs[lo : lo + 5000])
        cuts = library.pre_tokenizer.pre_tokenize_str(text)
        assert encoder.words(text) == [text[a:b] for _, (a, b) in cuts]


def test_pairs_are_compatible_when_merging_their_bytes_gives_them():
    rnd = random.Random(3)
    for _ in range(40):
        merges, known = [], ["a", "b", "c"]
        while len(merges) < 14:
            a, b = rnd.choice(known), rnd.choice(known)
            if a + b not in known and len(a + b) < 9:
                merges.append((a, b))
                known.append(a + b)
        v = B.Vocabulary(toy(merges))
        for t in known:
            assert v.whole[v.ids[t.encode()]] == (plain_merge(v, t.encode()) == [v.ids[t.encode()]]), (merges, t)
        fine = [v.ids[t.encode()] for t in known if v.whole[v.ids[t.encode()]]]
        pairs = np.array(list(itertools.product(fine, fine)))
        good = v.uncrossed(pairs[:, 0], pairs[:, 1], np.full(len(pairs), B.NEVER))
        for (a, b), ok in zip(pairs.tolist(), good.tolist(), strict=True):
            assert ok == (plain_merge(v, v.spelled[a] + v.spelled[b]) == [a, b]), (merges, v.spelled[a], v.spelled[b])
        encoder = B.Encoder(v)
        for _ in range(60):
            word = "".join(rnd.choice("abc") for _ in range(rnd.choice([1, 3, 8, 20, 47, 48, 49, 90])))
            assert encoder.encode(word).tolist() == plain_merge(v, word.encode())


def test_models_of_another_kind_are_refused(model):
    told = json.loads(model)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": told["model"] | {"ignore_merges": True}}):
        with pytest.raises(ValueError):
            B.Vocabulary(json.dumps(told | change).encode())
    with pytest.raises(ValueError):
        B.Vocabulary(toy([("a", "b"), ("b", "c"), ("a", "bc"), ("ab", "c")]))


def test_memory_is_bounded_and_changes_nothing(model, library, monkeypatch):
    monkeypatch.setattr(B, "MEMORY", 50)
    monkeypatch.setattr(B, "CHUNK_BYTES", 40)
    encoder = B.Encoder(B.Vocabulary(model))
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["the", "thing", "Ünder", "x" * 70, "of,", "qzx"]) + str(rnd.randint(0, 60)) for _ in range(30)) for _ in range(60)]
    for lo in range(0, 60, 5):
        got = encoder.encode_batch(texts[lo : lo + 5])
        assert [x.tolist() for x in got] == [x.ids for x in library.encode_batch(texts[lo : lo + 5], add_special_tokens=False)]


def test_rows(spark, library):
    long = "abc def\n" * 200_000
    rows = [(1, None, "x"), (2, "", None), (3, "The cat's <|endoftext|>  sat", "y"), (3, "The cat's <|endoftext|>  sat", "y"), (None, long, "z"), (5, "q" * 300_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string")
    out = B.tokenize(docs, B.model_bytes(), keep=("doc_id", "_text")).collect()
    assert len(out) == len(rows)
    want = {(i, x): library.encode(t or "", add_special_tokens=False).ids for i, t, x in rows}
    for r in out:
        ids = want[r.doc_id, r._text]
        text = next(t or "" for i, t, x in rows if (i, x) == (r.doc_id, r._text))
        assert r.ids == ids and r.n_tokens == len(ids) and r.round_trip
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert B.tokenize(docs.where("false"), B.model_bytes()).count() == 0


def test_query_over_the_whole_table(spark, library):
    from graphnom.llm import queries

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = queries.op13_bpe(spark, folder).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
