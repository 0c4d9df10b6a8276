"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision (the bits before it within the byte) has a context tree over
the bytes before, DEPTH deep. A node estimates by Krichevsky-Trofimov from its training counts and is mixed, half
and half at every depth, with what its children say: the weight of a node after training is that of its counts'
block probabilities, so trees are built from counts alone, in any order. The sum of -log2 over a text's
decisions is its code length.

Distribution. Words and grams (a byte and the DEPTH bytes before it) are counted without moving texts; trees are built
in shards of some SHARD grams, by the three nearest context bytes; the levels above are small (at most 2^24 nodes two
bytes deep, by bytes and bits, whatever the corpus). Then texts go into chunks of a bounded size; each chunk asks once
for each of its distinct words and grams, and is scored with the answers. The most frequent words and grams, FREQUENT
of them at most, need not be asked for: they are broadcast, which changes no score.

Defined cases: a null text is empty: one token (the end), coded by the end byte; without training documents
every count is 0 and every decision has probability 1/2; repeated rows and ties are scored alike; a very long text is
a chunk of its own, at some 60 bytes of memory a byte; an empty table gives an empty result; extra columns are
ignored unless in `keep`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textkit as K

DEPTH = 5
#: Bytes that UTF-8 does not have: before a text, and after it.
BEFORE, END = 0xFE, 0xFF
#: Bytes of text that are scored together, and distinct keys that a task counts before it hands them on.
CHUNK, HELD = 12 << 20, 2 << 20
#: Grams of a shard, about, and context bytes that all grams of a shard's tree share.
SHARD, NEAR = 200_000, 3
#: Most words and most grams that are broadcast: the most frequent ones.
FREQUENT = (1 << 19, 1 << 20)
#: The key of the end token among word hashes.
END_WORD = np.uint64(0x1E4D)
ADDED = 0.1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def grams(part: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram at each byte and after the last (the end byte) of each row, and each row's first gram."""
    n = len(places) - 1
    sizes = np.diff(places) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    seq = np.full(int(starts[-1]), END, np.uint64)
    ends = starts[1:] - 1
    inside = np.ones(len(seq), bool)
    inside[ends] = False
    seq[inside] = LOWER[part]
    at = np.arange(len(seq)) - np.repeat(starts[:-1], sizes)
    out = seq.copy()
    for k in range(1, DEPTH + 1):
        before = np.full(len(seq), BEFORE, np.uint64)
        before[k:] = np.where(at[k:] >= k, seq[:-k], BEFORE)
        out |= before << np.uint64(8 * k)
    return out, starts[: n + 1]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series above 8."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    z = x.copy()
    for _ in range(8):
        small = z < 8
        shift[small] += np.log(z[small])
        z[small] += 1
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def mixed(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    """ln(half own + half children), of logarithms."""
    return np.logaddexp(own, children) - np.log(2)


def own_share(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    """The weight that a node's own estimate has in its mixture."""
    return 1 / (1 + np.exp(np.clip(children - own, -700, 700)))


class Levels:
    """The tree nodes of some grams, from DEPTH up to depth NEAR."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        byte = keys & np.uint64(0xFF)
        context = keys >> np.uint64(8)
        bits = np.arange(8, dtype=np.uint64)
        self.prefix = (np.uint64(1) << bits) | (byte[:, None] >> (np.uint64(8) - bits))
        self.bit = ((byte[:, None] >> (np.uint64(7) - bits)) & np.uint64(1)).astype(bool)
        n = np.repeat(counts.astype(np.float64), 8)
        one = self.bit.reshape(-1)
        self.nodes: list[dict[str, np.ndarray]] = []
        for depth in range(DEPTH, NEAR - 1, -1):
            mask = np.uint64((1 << (8 * depth)) - 1)
            name, place = np.unique((((context & mask) << np.uint64(8))[:, None] | self.prefix).reshape(-1), return_inverse=True)
            ones, all_of = np.bincount(place, n * one, len(name)), np.bincount(place, n, len(name))
            level = {"name": name, "place": place, "ones": ones, "zeros": all_of - ones}
            level["own"] = block(level["zeros"], ones)
            level["children"] = np.zeros(len(name))
            if self.nodes:
                below = self.nodes[-1]
                parent = ((below["name"] >> np.uint64(8) & mask) << np.uint64(8)) | (below["name"] & np.uint64(0xFF))
                level["children"] = np.bincount(np.searchsorted(name, parent), below["weight"], len(name))
            level["weight"] = mixed(level["own"], level["children"]) if self.nodes else level["own"]
            self.nodes.append(level)

    def chances(self) -> np.ndarray:
        """Of each gram's decisions (all in one row): the depth-NEAR node's probability of a one."""
        p = None
        for level in self.nodes:
            own = (level["ones"] + 0.5) / (level["zeros"] + level["ones"] + 1)
            share = own_share(level["own"], level["children"])
            at = level["place"]
            p = own[at] if p is None else share[at] * own[at] + (1 - share[at]) * p
        return p


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often training rows hold each word (kind 0) and gram (kind 1) of all rows."""
    tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
    for batch in batches:
        data, offsets = K.buffer_of(batch.column(0))
        held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, part, places in K.pieces(data, offsets):
            for kind, found in enumerate((word_counts(part, places, held[lo:hi]), gram_counts(part, places, held[lo:hi]))):
                tables[kind] = merged(*tables[kind], *found)
                if len(tables[kind][0]) > HELD:
                    yield counted(kind, *tables[kind])
                    tables[kind] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for kind in (0, 1):
        yield counted(kind, *tables[kind])


def counted(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], ["kind", "key", "n"])


def word_counts(part: np.ndarray, places: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, and the end, and how often training rows have them."""
    found, rows = word_hashes(part, places)
    found = np.append(found, np.full(len(held), END_WORD))
    trained = np.append(np.repeat(~held, np.diff(rows)), ~held)
    order = np.argsort(found)
    return total_of(found[order], trained[order])


def gram_counts(part: np.ndarray, places: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and how often training rows have them (0: only held-out rows do)."""
    keys, starts = grams(part, places)
    # training grams carry a lowest bit, so that one sort tells both kinds apart
    marked = (keys << np.uint64(1)) | np.repeat(~held, np.diff(starts)).astype(np.uint64)
    values, n = np.unique(marked, return_counts=True)
    return total_of(values >> np.uint64(1), np.where(values & np.uint64(1), n, 0))


def total_of(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys may stand more than once: each once, with the sum of its counts."""
    if not len(keys):
        return keys, counts.astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts.astype(np.int64), first)


def merged(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([a, b]), np.concatenate([n, m])
    order = np.argsort(keys, kind="stable")
    return total_of(keys[order], counts[order])


def _summary(table: pa.Table) -> pa.Table:
    """Nodes of depth NEAR of a shard, summed over their farthest byte: nearer bytes and prefix, counts, weight."""
    top = Levels(table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()).nodes[-1]
    name = (top["name"] & np.uint64((1 << 8 * NEAR) - 1)).astype(np.int64)
    names, place = np.unique(name, return_inverse=True)
    sums = {k: np.bincount(place, top[k], len(names)) for k in ("zeros", "ones", "weight")}
    return pa.table({"name": pa.array(names.astype(np.int32)), **{k: pa.array(v) for k, v in sums.items()}})


class Top:
    """The levels above the shards: from NEAR - 1 bytes up to the root, a few numbers for each node."""

    def __init__(self, names: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray):
        #: of each level: sorted names (nearest bytes, prefix), estimates and shares
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for depth in range(NEAR - 1, -1, -1):
            own = block(zeros, ones)
            self.levels.append((names, (ones + 0.5) / (zeros + ones + 1), own_share(own, children)))
            if depth:
                weight = mixed(own, children)
                names, place = np.unique(names & ((1 << 8 * depth) - 1), return_inverse=True)
                zeros, ones, children = (np.bincount(place, v, len(names)) for v in (zeros, ones, weight))

    def mixed_in(self, p: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Chances from deeper levels, mixed with those of these; near: nearest bytes and prefix of each decision."""
        for k, (names, estimate, share) in enumerate(self.levels):
            at = np.searchsorted(names, near & ((1 << 8 * (NEAR - k)) - 1))
            p = share[at] * estimate[at] + (1 - share[at]) * p
        return p


def train(totals: DataFrame) -> DataFrame:
    """totals: key, n for each gram. Each gram's log10 probability: key, n, value."""
    C.ship_package(totals.sparkSession)
    shards = max(1, -(-totals.count() // SHARD))
    near = F.col("key").bitwiseAND(((1 << 8 * NEAR) - 1) << 8)
    groups = totals.withColumn("shard", F.pmod(F.xxhash64(near), F.lit(shards)).cast("int")).groupBy("shard")
    nodes = groups.applyInArrow(_summary, "name int, zeros double, ones double, weight double")
    nodes = nodes.groupBy("name").agg(*[F.round(F.sum(c), 6).alias(c) for c in ("zeros", "ones", "weight")])
    found = nodes.orderBy("name").toArrow()  # at most 2^16 pairs of bytes x 2^8 prefixes
    sent = totals.sparkSession.sparkContext.broadcast(Top(*(found[c].to_numpy().astype(np.int64 if c == "name" else np.float64) for c in ("name", "zeros", "ones", "weight"))))

    def score(table: pa.Table) -> pa.Table:
        keys = table["key"].to_numpy().view(np.uint64)
        levels = Levels(keys, table["n"].to_numpy())
        prefix = levels.prefix.reshape(-1).astype(np.int64)
        near = np.repeat((keys >> np.uint64(8) & np.uint64((1 << 8 * (NEAR - 1)) - 1)).astype(np.int64), 8) << 8 | prefix
        p = sent.value.mixed_in(levels.chances(), near)
        p = np.where(levels.bit.reshape(-1), p, 1 - p)
        return pa.table({"key": table["key"], "n": table["n"], "value": pa.array(np.log10(p).reshape(-1, 8).sum(axis=1).astype(np.float32))})

    return groups.applyInArrow(score, "key long, n long, value float")


class Lookup:
    """A hash table of keys with a number each: open addressing, all keys of an array probed together."""

    FREE = np.uint64(0x9D5E2C1B7A3F4E61)

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        self.bits = max(1, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, self.FREE)
        self.numbers = np.zeros(len(self.keys), numbers.dtype)
        left = np.arange(len(keys))
        at = self.start(keys)
        while len(left):
            free = self.keys[at] == self.FREE
            self.keys[at[free]] = keys[left[free]]  # of those that want one slot the last gets it
            got = self.keys[at] == keys[left]
            self.numbers[at[got]] = numbers[left[got]]
            left, at = left[~got], at[~got] + 1 & (1 << self.bits) - 1

    def start(self, keys: np.ndarray) -> np.ndarray:
        return (K.mix(keys + K.U64(0x5851F42D)) >> K.U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, or -1."""
        at = self.start(keys)
        held = self.keys[at]
        out = np.where(held == keys, at, -1)
        left = np.flatnonzero((held != keys) & (held != self.FREE))
        while len(left):
            at[left] = at[left] + 1 & (1 << self.bits) - 1
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit & (held != self.FREE)]
        out[keys == self.FREE] = -1
        return out


#: The tables of a worker, under the name of what was broadcast: its tasks share them.
_tables: dict[str, tuple[Lookup, Lookup]] = {}


def tables_of(sent) -> tuple[Lookup, Lookup]:
    """The frequent words and grams."""
    name, arrays = sent.value
    if name not in _tables:
        _tables.clear()
        _tables[name] = tuple(Lookup(*x) for x in arrays)
    return _tables[name]


def frequent(table: DataFrame, most: int, number: str) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """The rows of a table (key, n, value) but its most frequent ones, and keys and numbers of those, at most `most`."""
    # how many rows have each size of n, in steps of an eighth of a power of two
    step = F.floor(F.log2(F.col("n") + 1) * 8).cast("int")
    sizes = sorted(((r.s, r.c) for r in table.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, total = 1 << 30, 0
    for s, c in sizes:
        if total + c > most:
            break
        least, total = s, total + c
    free = F.col("key") == int(Lookup.FREE.view(np.int64))
    found = table.where((step >= least) & ~free).select("key", number).toArrow()
    return table.where((step < least) | free), (found["key"].to_numpy().view(np.uint64), found[number].to_numpy())


def word_hashes(part: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and each row's first word."""
    low = LOWER[part]
    spans = K.Spans(low, places)
    return K.span_hashes(low, spans.starts, spans.ends), spans.rows


def asker(sent) -> Callable[[pa.Table], pa.Table]:
    def ask(table: pa.Table) -> pa.Table:
        """Distinct words (kind 0) and grams (kind 1) of a chunk that are not among the frequent ones."""
        tables = tables_of(sent)
        seen = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        if table.num_rows:
            data, offsets = K.buffer_of(table["text"])
            for _, _, part, places in K.pieces(data, offsets):
                for kind, keys in enumerate((word_hashes(part, places)[0], grams(part, places)[0])):
                    seen[kind] = K.distinct(np.concatenate([seen[kind], K.distinct(keys[tables[kind].find(keys) < 0])]))
            if tables[0].find(np.array([END_WORD]))[0] < 0:
                seen[0] = K.distinct(np.append(seen[0], END_WORD))
        sizes = [len(x) for x in seen]
        chunk = table["chunk"][0].as_py() if table.num_rows else 0
        return pa.table({"chunk": pa.array(np.full(sum(sizes), chunk, np.int32)), "kind": pa.array(np.repeat([0, 1], sizes).astype(np.int32)), "key": pa.array(np.concatenate(seen).astype(np.uint64).view(np.int64))})

    return ask


def numbers_of(keys: np.ndarray, numbers: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The number of each asked key among sorted keys. A key without one raises: every key of a chunk's texts was asked
    for, so its texts are not those that asked."""
    at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
    if len(asked) and (not len(keys) or (keys[at] != asked).any()):
        raise LookupError("a chunk's texts hold keys that it has no answer for: its rows have changed since they asked")
    return numbers[at]


def answerer(sent) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def answer(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """Scores of a chunk's rows."""
        kind, keys = answers["kind"].to_numpy(), answers["key"].to_numpy().view(np.uint64)
        tables = tables_of(sent)
        own = []
        for k, number in ((0, "n"), (1, "value")):
            rows = np.flatnonzero(kind == k)
            rows = rows[np.argsort(keys[rows])]
            own.append((keys[rows], answers[number].to_numpy()[rows]))

        def look_up(k: int, asked: np.ndarray) -> np.ndarray:
            """Of each asked word how often it was seen in training (0), of each gram its log10 probability (1)."""
            slots = tables[k].find(asked)
            out = tables[k].numbers[slots].astype(np.float64)
            rest = np.flatnonzero(slots < 0)
            out[rest] = numbers_of(*own[k], asked[rest])
            return out

        n = texts.num_rows
        out = {k: np.zeros(n, np.int64) for k in ("n_tokens", "n_known", "n_bytes")} | {k: np.zeros(n) for k in ("base", "score")}
        end = float(look_up(0, np.array([END_WORD]))[0])
        data, offsets = K.buffer_of(texts["text"])
        for lo, hi, part, places in K.pieces(data, offsets):
            found, rows = word_hashes(part, places)
            count = look_up(0, found)
            row = np.repeat(np.arange(hi - lo), np.diff(rows))
            out["n_tokens"][lo:hi] = np.diff(rows) + 1
            out["n_known"][lo:hi] = np.bincount(row[count > 0], minlength=hi - lo) + int(end > 0)
            out["base"][lo:hi] = np.bincount(row, np.log10(count + ADDED), minlength=hi - lo) + np.log10(end + ADDED)
            asked, starts = grams(part, places)
            out["score"][lo:hi] = np.add.reduceat(look_up(1, asked), starts[:-1])
            out["n_bytes"][lo:hi] = np.diff(places)
        kept = [name for name in texts.column_names if name not in ("chunk", "held", "text")]
        return pa.table([*(texts[name] for name in kept), *(pa.array(x) for x in out.values())], names=[*kept, *out])

    return answer


def score(docs: DataFrame, held: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """held: a boolean column; rows where it is true are not learned from. The columns in `keep`, n_tokens,
    n_known, train_tokens, base_score (smoothed unigrams), score (log10 probability of the text by the context
    trees) and bits_per_byte."""
    spark = docs.sparkSession
    C.ship_package(spark)
    source = docs.select(*keep, F.coalesce(F.col(held), F.lit(False)).alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    totals = C.materialise(C.arrow_map(source.select("text", "held"), _count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = totals.where("kind = 0").select("key", "n", F.lit(0.0).cast("float").alias("value"))
    whole = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n, v = whole.n or 0, whole.v or 0
    known = C.materialise(train(totals.where("kind = 1").select("key", "n")))
    rest, tables = zip(*(frequent(t, most, number) for t, most, number in zip((words, known), FREQUENT, ("n", "value"), strict=True)), strict=True)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, tables))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK))
    # a row number, as equal rows shall not meet in one chunk
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int").alias("chunk")
    texts = source.select(chunk, *keep, "held", "text")
    asked = texts.groupBy("chunk").applyInArrow(asker(sent), "chunk int, kind int, key long")
    taught = rest[0].withColumn("kind", F.lit(0)).unionByName(rest[1].withColumn("kind", F.lit(1)))
    told = asked.join(taught.hint("merge"), ["kind", "key"]).select("chunk", "kind", "key", "n", "value")
    schema = C.with_fields(source.select(*keep).schema, "n_tokens long, n_known long, n_bytes long, base double, score double")
    scored = texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(answerer(sent), schema)
    total = float(np.log10(n + ADDED * (v + 1)))
    return scored.select(
        *keep, "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        F.round(F.col("base") - F.col("n_tokens") * F.lit(total), 6).alias("base_score"), F.round("score", 6).alias("score"),
        F.round(-F.col("score") / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1), 6).alias("bits_per_byte"),
    )
