"""Merkle fingerprints: against a plain tree, plain neighbours and plain overlaps; hot ids and copies."""

import collections
import hashlib
import random

import numpy as np
import pytest
from graphnom.llm import merkle as M
from graphnom.llm import textkit as K
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def hashed(data):
    return mixed(sum((b + 1) * pow(K.BASE, i, 1 << 64) for i, b in enumerate(data)) & MASK)


def plain_tree(text):
    """The fingerprint and its sections, paragraph by paragraph and block by block."""
    sections, digests, shown, raw = [], [], [], b""
    lines = text.encode().splitlines(keepends=True) if "\n" in text else [text.encode()] if text else []
    lines = [x + b"\n" for x in text.encode().split(b"\n")]
    lines[-1] = lines[-1][:-1]
    lines = [x for x in lines if x]
    before = None  # the last word of the text so far
    for n, line in enumerate(lines):
        blocks, now, word = [], b"", b""
        spaces = b" \t\n\x0b\x0c\r"
        for k, c in enumerate(line):
            starts_word = c not in spaces and (not word)
            if starts_word:
                if before is not None and hashed(before) % M.BLOCK_WORDS == 0 and now:
                    blocks.append(now)
                    now = b""
                rest = line[k:]
                end = next((i for i, x in enumerate(rest) if x in spaces), len(rest))
                word = rest[:end]
                before = word
                left = end
            now += bytes([c])
            if word:
                left -= 1
                if not left:
                    word = b""
        blocks.append(now)
        values = [hashed(x) for x in blocks]
        own = b"".join(v.to_bytes(8, "big") for v in values)
        raw += own
        node = hashlib.blake2b(own, digest_size=8).digest()
        digests.append(node)
        shown.append("".join(f"{v >> 64 - 4 * M.HEX:0{M.HEX}x}" for v in values))
        if line[:1] == b"\n" or node[0] % M.SECTION_PARAGRAPHS == 0 or n + 1 == len(lines):
            sections.append(hashlib.blake2b(b"".join(digests), digest_size=4).hexdigest() + ":" + "-".join(shown))
            digests, shown = [], []
    tree = ";".join(sections)
    return hashlib.blake2b(tree.encode() + raw, digest_size=16).hexdigest() + "|" + tree


def plain_likeness(a, b):
    if a == b:
        return 1.0
    leaves = [collections.Counter(p[i : i + M.HEX] for _, ps in M.tree_of(x) for p in ps for i in range(0, len(p), M.HEX)) for x in (a, b)]
    total = leaves[0].total() + leaves[1].total()
    return 2 * (leaves[0] & leaves[1]).total() / total if total else 1.0


def texts():
    rnd = random.Random(4)
    words = "the of and river stone maple harbor\u00e9 north letter garden winter 𝒳 bridge".split()
    out = ["", " ", "\n", "\n\n", "one", "one two", " \n\t ", "a\n\nb\n", "x" * 3000]
    out += ["".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\n", "\n\n", ". "]) for _ in range(rnd.randint(1, 90))) for _ in range(60)]
    return out


def test_fingerprints_against_a_plain_tree():
    every = texts()
    assert M.fingerprints(every) == [plain_tree(t) for t in every]
    prints = dict(zip(every, M.fingerprints(every)))
    assert len(set(prints.values())) == len(set(every))
    for a in every[:30]:
        for b in every[20:50]:
            x, y = prints[a], prints[b]
            assert M.likeness_of(x, y) == pytest.approx(plain_likeness(x, y)) == M.likeness_of(y, x)


def test_an_edit_is_located():
    text = "\n".join(f"paragraph {k} has words of its own {k * k} and some more" for k in range(60))
    a, b = M.fingerprints([text, text.replace("paragraph 30", "changed 30")])
    assert 0.9 < M.likeness_of(a, b) < 1 and M.likeness_of(a, a) == 1
    found = M.differing(b, a)
    assert len(found) == 1 and M.differing(a, a) == []
    section, paragraph = found[0]
    assert sum(len(ps) for _, ps in M.tree_of(b)[:section]) + paragraph == 30


def plain_rows(data):
    """doc_id, n_chars, edited text's digest, likenesses and branches, document by document."""
    order = sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[2], (x[1] or "").encode()))
    out = collections.Counter()
    for (k, text, _), (_, after, _) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        n = len(text)
        edit = text[: n - n // 2] + after[: n // 2]
        a, b, c = (plain_tree(x) for x in (text, edit, after))
        changed = M.differing(b, a)
        out[k, n, hashlib.sha256(edit.encode()).hexdigest(), a, b, round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9), len({i for i, _ in changed}), len(changed), "%d:%d" % changed[0] if changed else None] += 1
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_neighbours_against_a_plain_version(spark, parts):
    every = texts()
    rnd = random.Random(6)
    data = [(k * 3, t) for k, t in enumerate(every)] + [(None, None), (500, None), *[(None, t) for t in every[9:25]], *[(700, t) for t in every[15:40]]]
    data += [(None, every[30])] * 40 + [(900, every[31])] * 40 + [(901, every[31])]
    rnd.shuffle(data)
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in data], "doc_id long, text string, key string, hash string").repartition(parts)
    hashes = {r.t: r.h for r in frame.select(F.coalesce("text", F.lit("")).alias("t")).distinct().select("t", F.xxhash64("t").alias("h")).collect()}
    want = plain_rows([(k, t, hashes[t or ""]) for k, t in data])
    got = collections.Counter(tuple(r) for r in M.merkle_neighbours(frame).collect())
    assert got == want


def test_ranges_split_hot_ids():
    borders = np.array([(1, 5), (7, -9), (7, 3), (7, 8), (9, 0)], np.dtype([("key", np.int64), ("hash", np.int64)]))
    keys, hashes = (np.array(x, np.int64) for x in zip((0, 9), (1, 4), (1, 5), (6, 0), (7, -10), (7, -9), (7, 2), (7, 3), (7, 100), (8, 0), (9, -1), (9, 0), (10, 0)))
    at, lead = M.range_of(borders, keys, hashes)
    assert at.tolist() == [0, 0, 0, 0, 0, 1, 1, 2, 3, 3, 3, 4, 4]
    assert lead.tolist() == [False, False, True, False, False, True, False, True, False, False, False, True, False]


def test_small_tables(spark):
    frame = spark.createDataFrame([(5, "lonely words here")], "doc_id long, text string")
    assert M.merkle_neighbours(frame.limit(0)).count() == 0
    one = M.merkle_neighbours(frame).first()
    assert one.near_next == 1.0 and one.n_chars == 17
    long = spark.createDataFrame([(1, "word " * 300_000), (2, "b")], "doc_id long, text string")
    assert [r.n_chars for r in M.merkle_neighbours(long).orderBy("doc_id").collect()] == [1_500_000, 1]
