"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed word unigrams and bigrams: one learned from documents that
are trusted, one from the whole corpus. A document's own n-grams are left out of both when it is judged, so that a
small table does not favour what was learned from. The sum is divided by the number of n-grams of the text and held
against one threshold, which lies where labelled documents of both classes, judged alike, are parted with the least
error.

Defined cases: a null or wordless text has no words, fails the base rule and scores 0; a score equal to the threshold
is kept; a very long text is judged whole, in one piece; duplicated rows are judged alike; without any trusted document
the ratio is 0 everywhere and only the base rule decides; with fewer than LEAST_LABELLED documents of a class THRESHOLD
holds; an empty table gives an empty result; extra input columns are ignored unless named in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from graphnom.operators.ranges import running

from . import common as C
from . import textkit as K

#: Buckets of the n-gram table: the model's size, and so that of the broadcast, is fixed by it (1 MB).
BUCKETS = 1 << 16
#: Added to every bucket's raw count.
SMOOTHING = 0.5
#: Mean log ratio (nats per n-gram) below which a text is rejected where labels do not tell.
THRESHOLD = -0.115
#: Fewest labelled documents of each class, past the base rule, that a threshold is fitted on.
LEAST_LABELLED = 5
#: Labelled ids up to which they are sent to the tasks (8 bytes each), and labelled documents up to which the driver
#: seeks the threshold. Above it both are done by shuffles; all labels count in any case.
SENT_IDS, DRIVER_SCORES = 8_000_000, 100_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True


def ngram_buckets(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each unigram and bigram, and the row of each."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    pairs = K.window_hashes(words, 2)
    ok = K.within_row(rows, 2, len(pairs))
    shift = K.U64(64 - BUCKETS.bit_length() + 1)
    buckets = np.concatenate([K.mix(words + K.U64(1)) >> shift, pairs[ok] >> shift]).astype(np.int64)
    return buckets, np.concatenate([row, row[: len(pairs)][ok]])


class Known:
    """Distinct ids of labelled documents, and which rows have them. Up to SENT_IDS whole numbers go to the tasks as a
    sorted array, so that no text is shuffled; more ids, or others, are joined to the documents."""

    def __init__(self, labelled: DataFrame):
        self.ids = C.materialise(labelled.select("doc_id").where("doc_id is not null").distinct())
        self.sent = None
        if isinstance(self.ids.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType)) and self.ids.count() <= SENT_IDS:
            own = self.ids.select(F.col("doc_id").cast("long")).toArrow().column(0).to_numpy()
            self.sent = self.ids.sparkSession.sparkContext.broadcast(np.sort(own))

    def beside(self, docs: DataFrame, name: str) -> DataFrame:
        """docs with a column by which `flags` tells the rows of these ids."""
        if self.sent is not None and isinstance(docs.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType)):
            return docs.withColumn(name, F.col("doc_id").cast("long"))
        ids = self.ids.select(F.col("doc_id").alias("_known_id"), F.lit(True).alias(name))
        return docs.join(ids, F.col("doc_id") == F.col("_known_id"), "left").drop("_known_id").withColumn(name, F.coalesce(name, F.lit(False)))


def flags_of(sent: np.ndarray | None, column: pa.Array) -> np.ndarray:
    """Which rows have a known id, by the column that Known.beside makes. sent: the sorted ids, where it has sent them."""
    if pa.types.is_boolean(column.type):
        return column.to_numpy(zero_copy_only=False).astype(bool)
    if not len(sent):
        return np.zeros(len(column), bool)
    ids = column.fill_null(0).to_numpy()
    there = sent[np.minimum(np.searchsorted(sent, ids), len(sent) - 1)] == ids
    return there & column.is_valid().to_numpy(zero_copy_only=False)


class Ratio:
    """Counts of both models, and the ratio of a text with its own counts left out. The target is interpolated with the
    raw model, the more the less it has seen: a bucket that the smaller sample lacks tells little."""

    def __init__(self, raw: np.ndarray, target: np.ndarray):
        self.raw, self.target = raw + SMOOTHING, target.astype(float)
        self.raw_total, self.target_total = self.raw.sum(), self.target.sum()
        self.learned = bool(self.target_total)

    def scores(self, buckets: np.ndarray, row: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        """The mean log ratio of each row's n-grams; trusted: which rows the target has learned from."""
        n = np.bincount(row, minlength=len(trusted))
        if not self.learned or not len(row):
            return np.zeros(len(trusted))
        cells, counts = np.unique(row.astype(np.int64) * BUCKETS + buckets, return_counts=True)
        own, at = cells // BUCKETS, cells % BUCKETS
        mine = trusted[own]
        target_total = (self.target_total - n * trusted)[own]
        raw = (self.raw[at] - counts) / (self.raw_total - n)[own]
        target = (self.target[at] - counts * mine) / np.maximum(target_total, 1)
        share = target_total / (target_total + 2 * BUCKETS)
        return np.bincount(own, counts * np.log(share * target / raw + (1 - share)), minlength=len(trusted)) / np.maximum(n, 1)


def learn(docs: DataFrame, trusted: Known) -> Ratio:
    """trusted: the documents that the target is learned from. All documents are counted."""
    sent = trusted.sent

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = K.buffer_of(batch.column(0))
            flags = flags_of(sent and sent.value, batch.column(1))
            for lo, hi, part, places in K.pieces(data, offsets, K.PIECE_BYTES):
                spans = K.Spans(part, places)
                buckets, row = ngram_buckets(K.span_hashes(part, spans.starts, spans.ends), spans.rows)
                raw += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[flags[lo:hi][row]], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "trusted"])

    texts = trusted.beside(docs.select("doc_id", "text"), "_trusted").select("text", "_trusted")
    counts = C.arrow_map(texts, count, "bucket int, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts.bucket.to_numpy(dtype=np.int64)
    raw[at], target[at] = counts.raw.to_numpy(dtype=float), counts.trusted.to_numpy(dtype=float)
    return Ratio(raw, target)


def parting(good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold that rejects and keeps the least shares of the wrong class: of all such, the middle of the first
    stretch between two scores."""
    if min(len(good), len(bad)) < LEAST_LABELLED:
        return THRESHOLD
    scores = np.unique(np.concatenate([good, bad]))
    wrong = np.searchsorted(np.sort(good), scores) / len(good) + 1 - np.searchsorted(np.sort(bad), scores) / len(bad)
    best = int(np.round(wrong, 12).argmin())
    return float(scores[best] if best == 0 else (scores[best] + scores[best - 1]) / 2)


def parted(scored: DataFrame) -> float:
    """The same for a table (_good, score) of any size: by running counts over the scores."""
    by = C.materialise(scored.groupBy("score").agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad")))
    n = by.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    if n.good + n.bad <= DRIVER_SCORES:
        rows = by.toPandas()
        return parting(*[np.repeat(rows["score"].to_numpy(float), rows[side].to_numpy(np.int64)) for side in ("good", "bad")])
    if min(n.good, n.bad) < LEAST_LABELLED:
        return THRESHOLD
    so_far = running(by, [F.col("score")], {"goods": F.col("good"), "bads": F.col("bad")})
    # good ones below and bad ones from the score on, both by the product of the numbers: whole, so that ties are ties
    wrong = ((F.col("goods") - F.col("good")).cast("decimal(19,0)") * n.bad - (F.col("bads") - F.col("bad")).cast("decimal(19,0)") * n.good)
    best = so_far.agg(F.min_by("score", F.struct(wrong.alias("wrong"), "score"))).first()[0]
    before = by.where(F.col("score") < best).agg(F.max("score")).first()[0]
    return float(best if before is None else (best + before) / 2)


def base_counts(part: np.ndarray, places: np.ndarray, spans: K.Spans, words: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rule for each row of a buffer."""
    rows = spans.row_ids()
    out = {"n_words": spans.counts()}
    out["word_chars"] = K.per_row(spans.inside & ((part & 0xC0) != 0x80), places)
    out["n_symbols"] = K.per_row(SYMBOL[part], places)
    lines = K.Spans(part, places, NEWLINE)
    hashes, line_rows = K.span_hashes(part, lines.starts, lines.ends), lines.row_ids()
    worded = np.searchsorted(spans.starts, lines.ends) > np.searchsorted(spans.starts, lines.starts)
    keys = hashes[worded] ^ K.mix(line_rows[worded].astype(K.U64) + K.U64(7))
    out["n_dup_lines"] = np.bincount(line_rows[worded][K.repeated(keys)[1]], minlength=len(places) - 1)
    triples = K.window_hashes(words, 3)
    ok = np.flatnonzero(K.within_row(spans.rows, 3, len(triples)))
    again = ok[K.repeated(triples[ok] ^ K.mix(rows[ok].astype(K.U64) + K.U64(7)))[0]]
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[again + j] = True
    out["n_repeat_words"] = np.bincount(rows[covered], minlength=len(places) - 1)
    return out


def judged(docs: DataFrame, trusted: Known, ratio: Ratio, keep: tuple[str, ...], rejected: Known | None = None) -> DataFrame:
    """The columns in `keep`, the base counts, base_failed and score. rejected: only documents that are known as one of
    trusted and rejected are judged, and `_good` says as which."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    good, bad = trusted.sent, rejected and rejected.sent
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    first = 3 if rejected else 2

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags, side = flags_of(good and good.value, batch.column(1)), {}
            if first == 3:
                one = flags != flags_of(bad and bad.value, batch.column(2))
                batch, flags = batch.filter(pa.array(one)), flags[one]
                side = {"_good": pa.array(flags)}
            data, offsets = K.buffer_of(batch.column(0))
            found: list[dict[str, np.ndarray]] = []
            for lo, hi, part, places in K.pieces(data, offsets, K.PIECE_BYTES):
                spans = K.Spans(part, places)
                words = K.span_hashes(part, spans.starts, spans.ends)
                out = base_counts(part, places, spans, words)
                out["score"] = sent.value.scores(*ngram_buckets(words, spans.rows), flags[lo:hi])
                found.append(out)
            all_of = {k: np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in [*counts, "score"]}
            failed = (all_of["n_words"] < MIN_WORDS) | (100 * all_of["n_repeat_words"] > MAX_REPEAT_PERCENT * all_of["n_words"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[first:], *side.values(), *(pa.array(all_of[k].astype(np.int64)) for k in counts), pa.array(failed), pa.array(np.round(all_of["score"].astype(float), 9))],
                [*batch.schema.names[first:], *side, *counts, "base_failed", "score"],
            )

    # the kept columns may have any names: they go as one struct
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{k}`") for k in keep]).alias("_kept"))
    rows = trusted.beside(rows, "_trusted")
    rows = rejected.beside(rows, "_rejected").select("text", "_trusted", "_rejected", "_kept") if rejected else rows.select("text", "_trusted", "_kept")
    side = ["_good"] if rejected else []
    schema = C.with_fields(rows.schema[first:], ", ".join([*(f"{k} boolean" for k in side), *(f"{k} long" for k in counts), "base_failed boolean, score double"]))
    return C.arrow_map(rows, judge, schema).select("_kept.*", *side, *counts, "base_failed", "score")


def quality(docs: DataFrame, trusted: DataFrame, rejected: DataFrame | None = None, threshold: float | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, the base counts, base_failed, the length-normalised ratio and the verdict. trusted,
    rejected: labelled ids (doc_id) of both classes. threshold: by default where these are parted best."""
    good = Known(trusted)
    ratio = learn(docs, good)
    if threshold is None and rejected is not None:
        threshold = parted(judged(docs.select("doc_id", "text"), good, ratio, ("doc_id",), Known(rejected)).where("not base_failed").select("_good", "score"))
    limit = THRESHOLD if threshold is None else threshold
    return judged(docs, good, ratio, keep).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= limit))
