"""Byte-level BPE encoding by speculating and verifying, and decoding.

Encoding splits a text into words (the byte-level pattern) and merges each word's bytes, always the pair of least
rank first. Here the result is guessed instead: at each place of a word the longest token that fits is proposed. The
guess is right if and only if every token is what merging its own bytes gives, and every two neighbours are what
merging their joint bytes gives, for merges never cross a border that they do not cross in the pair alone. Tokens
are tested once, when the vocabulary is read; only those that pass are proposed. Neighbours are tested for all words
of a batch at once: each distinct pair is taken apart step by step, the merge made last first, and it fails if the
two parts that face each other at some moment could have been merged before the next step was due. Words in which no
pair fails are done; the others are merged exactly.

Words whose ids are known are taken from a bounded memory in front of all this. Special tokens are found in the text
before it is split, as the library does unless told otherwise.

Defined cases: null and empty texts have no ids and decode to the empty text; a word of any length is proposed and
tested in one pass, and merged exactly with a heap if a pair fails, so its cost grows by no more than n log n; of
equal ranks the leftmost pair is merged first; rows are independent, repeated ones get equal ids; an empty table
gives an empty result; other columns are ignored unless named in `keep`, and may have any names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from .pieces import decode

#: The pattern that splits a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker remembers (twice as many at most), and the longest of them, in characters.
MEMORY, REMEMBERED = 400_000, 64
#: Bytes of words that are proposed for at a time; a longer word is taken alone.
CHUNK_BYTES = 1 << 20
#: A rank above all others: the pair is never merged.
NEVER = np.iinfo(np.int64).max
NONE = (NEVER, -1)
#: Bytes of a word up to which merging looks through all its pairs at each step.
SHORT = 48


def byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where it prints, else the next free one."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE tokenizer, read from its JSON."""

    prefix = False  # decoding takes no space away

    def __init__(self, model: bytes):
        told = json.loads(model)
        bpe, split = told["model"], told["pre_tokenizer"] or {}
        plain = not any(bpe.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if bpe["type"] != "BPE" or not plain or told["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("only plain byte-level BPE tokenizers without a normalizer are known")
        byte = {sign: b for b, sign in enumerate(byte_signs())}
        self.ids = {bytes(byte[s] for s in text): k for text, k in bpe["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in told["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
            raise ValueError("special tokens that take in their neighbours are not known")
        n = self.n = 1 + max([*self.ids.values(), *self.specials.values()])
        self.spelled = [b""] * n
        for text, k in self.ids.items():
            self.spelled[k] = text
        for text, k in self.specials.items():
            self.spelled[k] = text.encode()
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)])
        size = np.array([len(x) for x in self.spelled], np.int64)
        self.size, self.start = size, np.cumsum(size) - size
        self.flat = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.names = [str(k) for k in range(n)]
        self.read_merges([m if isinstance(m, list) else m.split(" ") for m in bpe["merges"]], byte)
        self.whole = self.self_encoding()
        self.read_prefixes()

    def read_merges(self, merges: list[list[str]], byte: dict[str, int]) -> None:
        """ranks: the rank and result of each merge; left, right, rank: how each token is made (-1: of nothing)."""
        n = self.n
        self.left, self.right, self.rank = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        self.ranks: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y = (bytes(byte[s] for s in part) for part in (a, b))
            i, j, k = self.ids[x], self.ids[y], self.ids[x + y]
            if self.rank[k] >= 0:
                raise ValueError("a token that two merges make cannot be told by its pairs")
            self.left[k], self.right[k], self.rank[k] = i, j, r
            self.ranks[i * n + j] = (r, k)
        self.pair_keys = np.array(sorted(self.ranks), np.int64)
        self.pair_ranks = np.array([self.ranks[k][0] for k in self.pair_keys.tolist()], np.int64)

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        if not len(self.pair_keys):
            return np.full(len(key), NEVER)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def uncrossed(self, a: np.ndarray, b: np.ndarray, due: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border of each a and b. due: a facing pair of a lesser rank is merged before
        what comes next happens to either side. Steps are undone from the last one: that of the greater rank, on a
        tie the right one's, since of equal merges the left is made first."""
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(at):
            fine = self.merge_rank(a, b) >= due
            good[at[~fine]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = fine & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            undo_left = ra > rb
            due = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return good

    def self_encoding(self) -> np.ndarray:
        """Whether merging a token's own bytes gives the token: its parts' do, and nothing crosses their border before."""
        made = np.flatnonzero(self.rank >= 0)
        good = np.zeros(self.n, bool)
        good[self.byte_ids] = True
        fine = self.uncrossed(self.left[made], self.right[made], self.rank[made])
        for k, ok in sorted(zip(made.tolist(), fine.tolist(), strict=True), key=lambda x: self.rank[x[0]]):
            good[k] = ok and good[self.left[k]] and good[self.right[k]]
        return good

    def read_prefixes(self) -> None:
        """A tree of the prefixes of all tokens that may be proposed: from node and byte to node, by sorted keys."""
        nodes = {b"": 0}
        edges, token = [], [-1]
        for text, k in self.ids.items():
            if not self.whole[k]:
                continue
            for end in range(1, len(text) + 1):
                if text[:end] not in nodes:
                    nodes[text[:end]] = len(nodes)
                    token.append(-1)
                    edges.append((nodes[text[: end - 1]] * 256 + text[end - 1], len(nodes) - 1))
            token[nodes[text]] = k
        edges.sort()
        self.edge_keys, self.edge_to = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        self.token = np.array(token)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.base = vocabulary.byte_ids.tolist()
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was remembered before the memory was last full
        self.proposed = self.merged = 0  # words guessed at, and those of them that were merged exactly
        self.split = regex.compile(PATTERN).findall
        self.strange = newer_signs()
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(vocabulary.specials, key=len, reverse=True)) + ")") if vocabulary.specials else None
        self.fixed = {s: array("i", [k]).tobytes() for s, k in vocabulary.specials.items()}

    def words(self, text: str) -> list[str]:
        """The words of a text. Special tokens are words of their own, as no other word can be one."""
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)  # every second one is a special token
            return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self.words_between(p))]
        return self.words_between(text)

    def words_between(self, text: str) -> list[str]:
        if text.isascii() or not self.strange.search(text):
            return self.split(text)
        from tokenizers import pre_tokenizers  # signs that the two libraries may class differently: asked for

        cuts = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in cuts]

    def longest(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token from each byte that does not pass its word's end, and its length."""
        v = self.v
        token, size = v.byte_ids[data], np.ones(len(data), np.int64)
        at, node, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        while len(at):
            key = node * 256 + data[at + depth]
            found = np.minimum(np.searchsorted(v.edge_keys, key), len(v.edge_keys) - 1)
            ok = v.edge_keys[found] == key
            at, node = at[ok], v.edge_to[found[ok]]
            depth += 1
            here = v.token[node]
            token[at[here >= 0]] = here[here >= 0]
            size[at[here >= 0]] = depth
            on = at + depth < ends[at]
            at, node = at[on], node[on]
        return token, size

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words by longest match, joined, and each word's first place among them."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        token, size = self.longest(np.frombuffer(b"".join(words), np.uint8), np.repeat(ends, sizes))
        step, at, first, taken = size.tolist(), 0, [0], []
        for end in ends.tolist():
            while at < end:
                taken.append(at)
                at += step[at]
            first.append(len(taken))
        return token[np.array(taken, np.int64)], np.array(first)

    def verified(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether all neighbours within each word are compatible. Every distinct pair is tested once."""
        inside = np.ones(max(len(tokens) - 1, 0), bool)
        inside[first[1:-1] - 1] = False
        places = np.flatnonzero(inside)
        keys, which = np.unique(tokens[places] * self.v.n + tokens[places + 1], return_inverse=True)
        good = self.v.uncrossed(keys // self.v.n, keys % self.v.n, np.full(len(keys), NEVER))[which]
        out = np.ones(len(first) - 1, bool)
        out[np.searchsorted(first, places[~good], "right") - 1] = False
        return out

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word by merging: least rank first, the leftmost on a tie. Short words are looked through for
        each step, longer ones keep their pairs in a heap."""
        ranks, n, base = self.v.ranks, self.v.n, self.base
        ids = [base[b] for b in word]
        end = len(ids)
        if end <= SHORT:
            pairs = [ranks.get(a * n + b, NONE) for a, b in zip(ids, ids[1:])]  # noqa: B905
            while pairs and (best := min(pairs)) is not NONE:
                i = pairs.index(best)
                ids[i : i + 2] = [best[1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = ranks.get(ids[i - 1] * n + best[1], NONE)
                if i < len(pairs):
                    pairs[i] = ranks.get(best[1] * n + ids[i + 1], NONE)
            return ids
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        due = [(found[0], i, found[1]) for i in range(end - 1) if (found := ranks.get(ids[i] * n + ids[i + 1]))]
        heapq.heapify(due)
        while due:
            rank, i, to = heapq.heappop(due)
            if ids[i] < 0 or (j := after[i]) >= end or ranks.get(ids[i] * n + ids[j], (-1,))[0] != rank:
                continue
            ids[i], ids[j] = to, -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < end and (found := ranks.get(ids[a] * n + ids[b])):
                    heapq.heappush(due, (found[0], a, found[1]))
        return [k for k in ids if k >= 0]

    def solve(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words, as 32-bit numbers."""
        out, lo = {}, 0
        spelled = [w.encode() for w in words]
        while lo < len(words):
            hi, total = lo + 1, len(spelled[lo])
            while hi < len(words) and total + len(spelled[hi]) <= CHUNK_BYTES:
                total += len(spelled[hi])
                hi += 1
            tokens, first = self.propose(spelled[lo:hi])
            good = self.verified(tokens, first)
            joined, at = tokens.astype(np.int32).tobytes(), (first * 4).tolist()
            for k, fine in enumerate(good.tolist()):
                out[words[lo + k]] = joined[at[k] : at[k + 1]] if fine else array("i", self.merge(spelled[lo + k])).tobytes()
            self.proposed += hi - lo
            self.merged += int((~good).sum())
            lo = hi
        return out

    def parts(self, text: str) -> list[str]:
        """The text cut before each space, where no word goes across: none does unless white space is run together
        with a space after it, in which case the words themselves are the parts."""
        if "  " in text or (self.special is not None and self.special.search(text)):
            return self.words(text)
        cut = text.replace(" ", "\0 ").split("\0") if "\0" not in text else self.words(text)
        return cut if cut[0] else cut[1:]

    def looked_up(self, rows: list[list[str]], solve: Callable[[list[str]], dict[str, bytes]]) -> list[bytes]:
        """The joined ids of each row's parts, from memory or else by `solve`, once for all rows."""
        get, out = self.memory.get, []
        found = [list(map(get, row)) for row in rows]
        missing = dict.fromkeys(p for row, got in zip(rows, found, strict=True) if None in got for p, ids in zip(row, got, strict=True) if ids is None)
        known = {p: ids for p in missing if (ids := self.fixed.get(p) or self.older.get(p))}
        known |= solve([p for p in missing if p not in known])
        for row, got in zip(rows, found, strict=True):
            out.append(b"".join([ids if ids is not None else known[p] for p, ids in zip(row, got, strict=True)] if None in got else got))
        if len(self.memory) + len(known) > MEMORY:
            self.older, self.memory = self.memory, {}
        self.memory.update((p, ids) for p, ids in known.items() if len(p) <= REMEMBERED)
        return out

    def by_words(self, parts: list[str]) -> dict[str, bytes]:
        return dict(zip(parts, self.looked_up([self.words(p) for p in parts], self.solve), strict=True)) if parts else {}

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, np.int32) for ids in self.looked_up([self.parts(t) if t else [] for t in texts], self.by_words)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]


def newer_signs() -> re.Pattern:
    """Signs that are letters, numbers or spaces to one library and may be unassigned to the other, as they follow
    different versions of Unicode: those that are unassigned to Python."""
    known = regex.compile(r"[\p{L}\p{N}\s]").match
    cut = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn" and known(chr(c))]
    begins = [c for k, c in enumerate(cut) if not k or cut[k - 1] != c - 1]
    ends = [c for k, c in enumerate(cut) if k + 1 == len(cut) or cut[k + 1] != c + 1]
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(begins, ends, strict=True)) + "]" if cut else "(?!)")


#: The encoder of a worker, under its model's digest: the tasks of a worker share what it remembers.
_encoders: dict[bytes, Encoder] = {}


def encoder_of(model: bytes) -> Encoder:
    key = hashlib.sha256(model).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(model))
    return _encoders[key]


def tokenize(docs: DataFrame, model: bytes, keep: tuple[str, ...] = ("doc_id",), ids: bool = True, digests: bool = True) -> DataFrame:
    """The columns in `keep`; with ids: ids (array<int>); with digests: n_tokens, ids_sha256 (of the decimal ids joined by
    commas), decoded_sha256 and round_trip, whether decoding gave the text again."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(sent.value)
        v = encoder.v
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                texts = [x or "" for x in batch.column(0).to_pylist()]
                found = encoder.encode_batch(texts)
                columns: dict[str, pa.Array] = {}
                if ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                if digests:
                    decoded = [decode(v, x) for x in found]
                    written = [",".join([v.names[k] for k in x.tolist()]) for x in found]
                    columns["n_tokens"] = pa.array([len(x) for x in found], pa.int64())
                    columns["ids_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in written], pa.string())
                    columns["decoded_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())
                    columns["round_trip"] = pa.array([a == b for a, b in zip(texts, decoded, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns.values()], [*batch.schema.names[1:], *columns])

    more = ["ids array<int>"] * ids + ["n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"] * digests
    return C.arrow_map_kept(C.text_first(docs, "text", keep), run, ", ".join(more))


def model_bytes(path: str | None = None, spark: SparkSession | None = None) -> bytes:
    """The tokenizer file's bytes. path: by default that of the public 50k byte-level one; one with a scheme is read
    by Spark, any other by the driver."""
    path = path or "/opt/tokenizers/byte_bpe_50k.json"
    if "://" in path:
        return bytes((spark or SparkSession.active()).read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()
