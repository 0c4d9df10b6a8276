"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased letters; everything else is one separator. The log-probability matrix has a fixed
number of buckets for each language and is broadcast; a batch is scored by gathering its rows for all n-grams
at once and summing them by document.

More than MAX_LANGUAGES languages raise: the matrix is one broadcast, and is not cut.

Defined cases: a text that is null or holds no letter gives `und` with score 0, as does every text when
nothing was learned; equal posteriors go to the language first in code-point order; a null language is
not learned from; a very long text is scored whole, in one piece; duplicated rows count as often as they stand; an
empty table gives an empty result; extra columns are ignored unless named in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textkit as K

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Most languages; with BUCKETS it bounds the broadcast matrix (64 MB). More raise an error.
MAX_LANGUAGES = 512
#: Counters that a task holds before it hands them on.
HELD = 1 << 22

_folded: list[np.ndarray] = []


def folding() -> np.ndarray:
    """Each code point's lower-case letter, or 0 where it is no letter."""
    if not _folded:
        out = np.zeros(0x110000, np.uint32)
        for cp in range(0x110000):
            if (c := chr(cp)).isalpha():
                low = c.lower()
                out[cp] = ord(low) if len(low) == 1 else cp
        _folded.append(out)
    return _folded[0]


def character_grams(part: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of each n-gram that has a letter, and each row's number of letters."""
    points = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    chars = np.diff(places) if len(points) == len(part) else K.per_row((part & 0xC0) != 0x80, places)
    rows = np.repeat(np.arange(len(chars), dtype=np.int32), chars)
    letters = folding()[points]
    at = np.flatnonzero(letters != 0)
    n = len(letters)
    found, owner = [], []
    own = rows[at]
    code = np.full(len(at), 0, np.uint64)
    before = np.where((at > 0) & (rows[np.maximum(at - 1, 0)] == own), letters[np.maximum(at - 1, 0)], 0).astype(np.uint64)
    after = np.where((at + 1 < n) & (rows[np.minimum(at + 1, n - 1)] == own), letters[np.minimum(at + 1, n - 1)], 0).astype(np.uint64)
    code = letters[at].astype(np.uint64)
    for order, key in ((1, code), (2, code | (before << np.uint64(21))), (3, code | (before << np.uint64(21)) | (after << np.uint64(42)))):
        if order in ORDERS:
            found.append((K.mix(key + np.uint64(order * K.BASE % (1 << 64))) >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64))
            owner.append(own)
    return np.concatenate(found), np.concatenate(owner), np.bincount(own, minlength=len(chars))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, row in counts.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "bucket": pa.array(used.astype(np.int32)), "n": pa.array(row[used])})
        counts.clear()

    for batch in batches:
        names = batch.column(1).to_pylist()
        data, offsets = K.buffer_of(batch.column(0))
        for lo, hi, part, places in K.pieces(data, offsets):
            buckets, rows, _ = character_grams(part, places)
            own = names[lo:hi]
            kinds = sorted(set(own))
            index = np.array([kinds.index(x) for x in own])
            for k, lang in enumerate(kinds):
                row = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                row += np.bincount(buckets[index[rows] == k], minlength=BUCKETS + 1)
                row[BUCKETS] += int((index == k).sum())  # documents, for the prior
            if len(counts) * BUCKETS > HELD:
                yield from flush()
    yield from flush()


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (bucket, language) and log priors, over all rows of docs (text, lang)."""
    labelled = docs.where("lang is not null and text is not null").select("text", "lang")
    counts = C.arrow_map(labelled, _learn, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = C.materialise(counts)
    names = [r.lang for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(names)
    table = np.zeros((BUCKETS + 1, len(names)))
    # one language at a time: at most BUCKETS + 1 rows each
    for k, lang in enumerate(names):
        found = counts.where(F.col("lang") == lang).select("bucket", "n").toArrow()
        table[found["bucket"].to_numpy(), k] = found["n"].to_numpy()
    grams, prior = table[:BUCKETS] + SMOOTHING, table[BUCKETS] + 1.0
    return names, np.log(grams / grams.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum()) if names else prior


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, lang_pred and score (posterior of the predicted language)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs, prior = sent.value
        for batch in batches:
            data, offsets = K.buffer_of(batch.column(0))
            langs: list[str] = []
            scores: list[float] = []
            for lo, hi, part, places in K.pieces(data, offsets):
                size = hi - lo
                if not names:
                    langs += ["und"] * size
                    scores += [0.0] * size
                    continue
                buckets, rows, letters = character_grams(part, places)
                total = np.tile(prior, (size, 1))
                for k in range(len(names)):
                    total[:, k] += np.bincount(rows, logs[:, k][buckets], minlength=size)
                best = total.argmax(axis=1)
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                chance = np.round(odds.max(axis=1) / odds.sum(axis=1), 9)
                langs += [names[b] if n else "und" for b, n in zip(best, letters, strict=True)]
                scores += [float(c) if n else 0.0 for c, n in zip(chance, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    kept = C.text_first(docs, "text", keep)
    return C.arrow_map_kept(kept, predict, "lang_pred string, score double")
