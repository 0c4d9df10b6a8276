"""Merkle fingerprints of documents: root over sections, sections over paragraphs, paragraphs over blocks.

A paragraph is a line with its line break. A paragraph is cut into blocks after words chosen by their own
hash, and a section ends after an empty line or after a paragraph chosen by its own hash, so borders move
with the text and an edit changes only the branches it touches. Blocks cover every byte of the text.

A fingerprint is `root|section:block block...-block...;section:...` with digests as hex digits; equal texts
have equal fingerprints, and roots alone decide equality. Two trees are compared from the root down: equal roots,
sections and paragraphs are not looked into; the branches left over are where the texts differ (`differing`), and
of their blocks those that both have still count as alike (`likeness`).

Defined cases: a null text counts as empty and has a root without sections; two empty texts are alike (1.0);
rows of equal doc_id are ordered by a hash of their text, then by the text, and null doc_id stands first; of rows equal
in both, each is followed by the next copy, the last by another document; a very long text is read whole, alone; an
empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textkit as K

#: One word in so many ends a block, one paragraph in so many ends a section.
BLOCK_WORDS = 4
SECTION_PARAGRAPHS = 4
#: Hex digits of a block's digest in a fingerprint; an even number.
HEX = 6
LEAST = -(1 << 63)


def digest(data: bytes, size: int) -> str:
    return hashlib.blake2b(data, digest_size=size).hexdigest()


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text."""
    out: list[str] = []
    if not texts:
        return out
    data, offsets = K.buffer_of(pa.array([t or "" for t in texts], pa.large_string()))
    for _, _, part, places in K.pieces(data, offsets):
        spans = K.Spans(part, places)
        words = K.span_hashes(part, spans.starts, spans.ends)
        first = np.zeros(len(words), bool)
        first[spans.rows[:-1][spans.counts() > 0]] = True
        cut = np.flatnonzero((words[:-1] % K.U64(BLOCK_WORDS) == 0) & ~first[1:]) + 1 if len(words) else np.zeros(0, np.int64)
        line = np.flatnonzero(part == 0x0A) + 1
        filled = places[:-1][np.diff(places) > 0]
        starts = K.distinct(np.concatenate([filled, spans.starts[cut], line[line < len(part)]]))
        ends = np.append(starts[1:], len(part))
        blocks = K.span_hashes(part, starts, ends)
        opens = np.zeros(len(part) + 1, bool)
        opens[line] = True
        opens[filled] = True
        leaf_hex = blocks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, : HEX // 2].tobytes().hex()
        raw = blocks.astype(">u8").tobytes()
        row_first = np.searchsorted(starts, places)
        paragraph = np.flatnonzero(opens[starts])
        blank = part[starts[paragraph]] == 0x0A if len(paragraph) else np.zeros(0, bool)
        paragraph_row = np.searchsorted(paragraph, row_first)
        paragraph = np.append(paragraph, len(starts)).tolist()
        row_of, empty = paragraph_row.tolist(), blank.tolist()
        for row in range(len(places) - 1):
            sections: list[str] = []
            digests: list[bytes] = []
            shown: list[str] = []
            lo, hi = row_of[row], row_of[row + 1]
            for p in range(lo, hi):
                a, b = paragraph[p], paragraph[p + 1]
                node = hashlib.blake2b(raw[8 * a : 8 * b], digest_size=8).digest()
                digests.append(node)
                shown.append(leaf_hex[HEX * a : HEX * b])
                if empty[p] or node[0] % SECTION_PARAGRAPHS == 0 or p + 1 == hi:
                    sections.append(f"{digest(b''.join(digests), 4)}:{'-'.join(shown)}")
                    digests, shown = [], []
            tree = ";".join(sections)
            # leaves are shown in part, so the root takes them whole
            own = raw[8 * int(row_first[row]) : 8 * int(row_first[row + 1])]
            out.append(f"{digest(tree.encode() + own, 16)}|{tree}")
    return out


def tree_of(fingerprint: str) -> list[tuple[str, list[str]]]:
    """Sections with their paragraphs; a paragraph is its blocks' digests, HEX digits each."""
    body = fingerprint.partition("|")[2]
    return [(head, inside.split("-")) for head, _, inside in (x.partition(":") for x in body.split(";"))] if body else []


def unmatched(a: list[str], b: list[str]) -> tuple[list[int], list[int]]:
    """Places in a and in b that no equal entry of the other list is left for."""
    if a == b:
        return [], []
    free: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        free.setdefault(b[j], []).append(j)
    lost = [i for i, x in enumerate(a) if not (x in free and free[x] and free[x].pop() >= 0)]
    return lost, sorted(j for places in free.values() for j in places)


class Comparison:
    """Two trees, walked from the root down."""

    def __init__(self, a: list[tuple[str, list[str]]], b: list[tuple[str, list[str]]]):
        # a section's digest is short, so its blocks are part of what has to be equal
        sections = unmatched(["".join((h, *ps)) for h, ps in a], ["".join((h, *ps)) for h, ps in b])
        left = [[(i, j, p) for i in own for j, p in enumerate(tree[i][1])] for tree, own in zip((a, b), sections, strict=True)]
        paragraphs = unmatched([p for *_, p in left[0]], [p for *_, p in left[1]])
        #: (section, paragraph) places of a that b does not have
        self.changed = [left[0][k][:2] for k in paragraphs[0]]
        rest = [Counter(left[side][k][2][i : i + HEX] for k in paragraphs[side] for i in range(0, len(left[side][k][2]), HEX)) for side in (0, 1)]
        self.sizes = [sum(len(p) for _, ps in tree for p in ps) // HEX for tree in (a, b)]
        self.shared = self.sizes[0] - rest[0].total() + (rest[0] & rest[1]).total()

    def likeness(self) -> float:
        """The share of the blocks of both trees that the other one has too."""
        return 2 * self.shared / sum(self.sizes) if sum(self.sizes) else 1.0


def likeness_of(a: str, b: str) -> float:
    return 1.0 if a == b else Comparison(tree_of(a), tree_of(b)).likeness()


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places of a that b's tree does not have: where the edit lies."""
    return [] if a.partition("|")[0] == b.partition("|")[0] else Comparison(tree_of(a), tree_of(b)).changed


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the following text."""
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


#: What a row is in the range that it is sent to: a document of it, the first of the range after it, or a copy that
#: another one follows, which may stand anywhere.
OWN, TAIL, COPY = 0, 1, 2


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], list[str]]]:
    """Lists of ids, of texts, and of the texts that follow each: the next in the list, or the same text for copies."""
    ids: list = []
    texts: list[str] = []
    held, done_with = 0, None
    copied: tuple[list, list[str]] = ([], [])
    copied_size = 0
    for batch in batches:
        for pid, kind, doc, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            text = text or ""
            if kind == COPY:
                copied[0].append(doc)
                copied[1].append(text)
                copied_size += len(text)
                if copied_size > K.CHUNK_BYTES:
                    yield *copied, copied[1]
                    copied, copied_size = ([], []), 0
                continue
            if kind == TAIL:
                if done_with != pid and ids:
                    yield ids, texts, [*texts[1:], text]
                ids, texts, held, done_with = [], [], 0, pid
                continue
            if held > K.CHUNK_BYTES:
                yield ids, texts, [*texts[1:], text]
                ids, texts, held = [], [], 0
            ids.append(doc)
            texts.append(text)
            held += len(text)
    if copied[0]:
        yield *copied, copied[1]
    assert not ids, "each range ends with its successor"


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts, following in _neighbours(batches):
        edits = [edited_text(a, b) for a, b in zip(texts, following, strict=True)]
        prints = fingerprints([*texts, following[-1]])
        edit_prints = fingerprints(edits)
        trees = [tree_of(x) for x in prints]
        edited = [None if a == b else Comparison(tree_of(b), t) for a, b, t in zip(prints, edit_prints, trees, strict=False)]
        after = [None] * len(ids) if following is texts else [None if a == b else Comparison(t, u) for a, b, t, u in zip(prints, prints[1:], trees, trees[1:], strict=False)]
        near = lambda found: pa.array([1.0 if c is None else round(c.likeness(), 9) for c in found], pa.float64())
        changed = [[] if c is None else c.changed for c in edited]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_chars": pa.array([len(x) for x in texts], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edits], pa.string()),
                "fingerprint": pa.array(prints[:-1], pa.string()),
                "edited_fingerprint": pa.array(edit_prints, pa.string()),
                "near_edited": near(edited),
                "near_next": near(after),
                "edited_sections": pa.array([len({i for i, _ in c}) for c in changed], pa.int64()),
                "edited_paragraphs": pa.array([len(c) for c in changed], pa.int64()),
                "first_edited": pa.array(["%d:%d" % c[0] if c else None for c in changed], pa.string()),
            }
        )


def range_of(borders: np.ndarray, keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range (of those that begin at the sorted (key, hash) borders) that each row is in, and whether it is a
    border itself. A key may hold several borders."""
    own = np.empty(len(keys), borders.dtype)
    own["key"], own["hash"] = keys, hashes
    low, high = (np.searchsorted(borders["key"], keys, side) for side in ("left", "right"))
    at = high - 1
    for k in np.unique(keys[high > low]):  # keys that hold borders: of those, a row's hash tells which
        rows = np.flatnonzero(keys == k)
        first, last = low[rows[0]], high[rows[0]]
        at[rows] = first + np.searchsorted(borders["hash"][first:last], hashes[rows], "right") - 1
    at = np.maximum(at, 0)
    return at, own == borders[at]


def merkle_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, its likeness to that and to the next document, and the
    branches of the edited text's tree that its own lacks: how many sections and paragraphs, and the first as
    `section:paragraph`, both from 0.

    Texts are shuffled once, into ranges of doc_id and text hash; each range also gets the first document of the range
    after it (the last range: of the first), so that no row needs a window over the whole table. Of rows that a batch
    holds several times only one takes part in the order, so that no range fills up with copies.
    """
    ranges = max(1, docs.rdd.getNumPartitions())
    key, text_hash = F.coalesce("doc_id", F.lit(LEAST)).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")
    firsts = docs.select(key, text_hash).repartitionByRange(ranges, "key", "hash").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("key", "hash")).alias("b"))
    # two numbers for each range
    borders = np.array(sorted((r.b["key"], r.b["hash"]) for r in firsts.collect()), np.dtype([("key", np.int64), ("hash", np.int64)]))
    last = max(len(borders) - 1, 0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            keys, hashes = batch.column(0).fill_null(LEAST).to_numpy(), batch.column(2).to_numpy()
            at, lead = range_of(borders, keys, hashes)
            seen: dict[tuple, str] = {}
            copy = np.zeros(len(keys), bool)
            for k, pair in enumerate(zip(keys.tolist(), hashes.tolist(), strict=True)):
                if pair in seen:
                    copy[k] = batch.column(1)[k].as_py() == batch.column(1)[seen[pair]].as_py()
                else:
                    seen[pair] = k
            own, lead = np.flatnonzero(~copy), np.flatnonzero(lead & ~copy)
            copies = np.flatnonzero(copy)
            take = np.concatenate([own, lead, copies])
            spread = (copies + number) % (last + 1)
            pid = np.concatenate([at[own], np.where(at[lead] == 0, last, at[lead] - 1), spread])
            kind = np.repeat([OWN, TAIL, COPY], [len(own), len(lead), len(copies)])
            rows = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(pid.astype(np.int32)), pa.array(kind.astype(np.int32)), *rows.columns], ["pid", "kind", "doc_id", "text", "hash"])

    placed = C.arrow_map(docs.select("doc_id", "text", text_hash), place, "pid int, kind int, doc_id long, text string, hash long")
    ordered = placed.repartitionById(ranges, "pid").sortWithinPartitions("pid", "kind", "doc_id", "hash", "text").select("pid", "kind", "doc_id", "text")
    return C.arrow_map(ordered, _score, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_sections long, edited_paragraphs long, first_edited string")
