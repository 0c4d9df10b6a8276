"""Near-duplicate classes by ProbMinHash, banding and verification.

A document is the weighted set of its shingles of five words (weight: how often it holds them). Each shingle
sends a Poisson process of its weight's rate over the registers; a register keeps its earliest arrival and whose
it was. Once an arrival is later than every register's, its shingle ends. Two documents agree in a register with
their probability Jaccard similarity, which for equal weights is the Jaccard similarity.

Texts of equal words are one node. Bands of registers put nodes into buckets; pairs of bands make narrow buckets
beside them, which hold closer nodes only. Within a bucket nodes are first compared
with a leader: the node that most others share buckets with leads, in some buckets an order of their own decides. In
small buckets each node meets its next ones instead, which is all of them in the smallest. Leaders are elected within
each batch of rows, then among those, so a bucket that holds a third of all rows is spread over all tasks. Every pair
compared is verified by its exact similarity. Verified links make classes by connected components. That settles most
buckets. Those that still hold more than one class, and were not compared in full, are settled then: each two of their
nodes are verified unless they are in one class by then. So any two nodes that share a band are verified or already in
one class, whatever their bucket's size; who led, and how rows were batched, changes no class.

Defined cases: null and wordless texts have no shingles and are copies of each other, one class; fewer than five
words are one shingle; a class is named by its least doc_id (null ids stand last); a similarity equal to the threshold
links, and of equal leaders the lesser hash leads; equal rows share a class; a very long text is shingled whole, at
some 60 bytes of memory a byte; an empty table gives an empty result; extra columns are ignored unless in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textkit as K
from .components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
#: Texts of at most so many distinct shingles are signed together, a batch at a time.
FEW = 160
#: Narrow buckets join each band with the one so many further on.
NARROW = (1, 2, 3)
#: Bands by which it is told how many others a node is like.
POPULAR_BANDS = 8
#: Of so many buckets (and of more narrow ones), one elects its leader by an order of its own.
OWN_ORDER = 8
#: Buckets of up to so many nodes pair each with its next ones in the bucket's own order, so those of up to
#: 2 * NEIGHBOURS + 1 are compared in full.
SMALL, NEIGHBOURS = 24, 4
#: Nodes of a bucket that are compared at a time with as many others, and shingles looked up at a time.
BLOCK, LOOKUPS = 1024, 1 << 18
#: Bits of the filter that keeps texts which no comparison needs from being shuffled. Its size is fixed (8 MB);
#: a full one lets all pass, and each node is still sent once by a task.
FILTER_BITS = 1 << 26
EMPTY = 0x1CE


def shingles(part: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, the first shingle of each row (and the end), and each row's hash of all its words."""
    spans = K.Spans(part, places)
    words = K.span_hashes(part, spans.starts, spans.ends)
    counts = spans.counts()
    windows = K.window_hashes(words, WORDS)
    inside = np.flatnonzero(K.within_row(spans.rows, WORDS, len(windows)))
    row_of = np.repeat(np.arange(len(counts)), counts)
    hashes, rows = windows[inside], row_of[inside]
    # the words of a row as one polynomial, and short rows as one shingle
    up, down = K.powers(len(words) + 1)
    total = np.zeros(len(words) + 1, K.U64)
    np.cumsum(words * up[:-1], out=total[1:])
    first, end = spans.rows[:-1], spans.rows[1:]
    nodes = K.mix((total[end] - total[first]) * down[np.minimum(first, len(words))] + counts.astype(K.U64) * K.U64(EMPTY))
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        hashes, rows = np.concatenate([hashes, K.mix(nodes[short])]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
    return hashes, np.searchsorted(rows, np.arange(len(counts) + 1)), nodes


def weighted(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: row, hash, weight."""
    rows = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))


def signatures(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: for each row and register the shingle that arrived there first (0 for a row without any)."""
    earliest = np.full(n * registers, np.inf)
    owner = np.zeros(n * registers, K.U64)
    latest = np.full(n, np.inf)
    # of the shingles that can still win: row, hash, generator state, rate, time of the last arrival
    rate, time, state = weights.astype(np.float64), np.zeros(len(rows)), K.mix(hashes + K.U64(0xA5A5))
    t = 0
    while len(rows):
        t += 1
        draw = K.mix(state + K.U64(t * K.BASE % (1 << 64)))
        time = time - np.log(((draw >> K.U64(12)).astype(np.float64) + 0.5) * 2.0**-52) / rate
        soon = time < latest[rows] if t > 1 else slice(None)
        rows, hashes, state, rate, time, draw = rows[soon], hashes[soon], state[soon], rate[soon], time[soon], draw[soon]
        if not len(rows):
            break
        slot = rows * registers + ((draw & K.U64(0xFFFFFFFF)) * K.U64(registers) >> K.U64(32)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        won = earliest[slot] == time
        owner[slot[won]] = hashes[won]
        # an arrival after every register's ends its shingle: so do all that follow
        live = rows[np.flatnonzero(np.diff(rows, prepend=-1))]
        latest[live] = earliest.reshape(n, registers)[live].max(axis=1)
        soon = time < latest[rows]
        rows, hashes, state, rate, time = rows[soon], hashes[soon], state[soon], rate[soon], time[soon]
    return owner.reshape(n, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One key for each band of each row."""
    grouped = signature.reshape(len(signature), BANDS, ROWS)
    out = np.zeros(grouped.shape[:2], K.U64)
    for j in range(ROWS):
        out += grouped[:, :, j] * K.U64(pow(K.BASE, 2 * j + 3, 1 << 64))
    return K.mix(out + np.arange(BANDS, dtype=K.U64) * K.U64(0x51ED270B))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.buffer_of(batch.column(0))
        n = len(offsets) - 1
        keys, nodes, sizes = np.zeros((n, BANDS), K.U64), np.zeros(n, K.U64), np.zeros(n, np.int32)
        short: list[tuple[np.ndarray, ...]] = []  # few shingles need many arrivals each: those texts go together
        for lo, hi, part, places in K.pieces(data, offsets, K.PIECE_BYTES):
            hashes, firsts, nodes[lo:hi] = shingles(part, places)
            sizes[lo:hi] = np.where(np.diff(firsts) > 0, BANDS, 0)
            rows, hashes, weights = weighted(hashes, firsts)
            few = (np.bincount(rows, minlength=hi - lo) <= FEW)[rows]
            short.append((rows[few] + lo, hashes[few], weights[few]))
            if not few.all():
                own, back = np.unique(rows[~few], return_inverse=True)
                keys[own + lo] = band_keys(signatures(back, hashes[~few], weights[~few], len(own)))
        if n:
            rows, hashes, weights = (np.concatenate(x) for x in zip(*short, strict=True))
            own, back = np.unique(rows, return_inverse=True)
            keys[own] = band_keys(signatures(back, hashes, weights, len(own)))
        bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(keys[sizes > 0].reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(nodes.view(np.int64)), bands], [*batch.schema.names[1:], "_node", "_bands"])


def bucket_keys(bands: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    """Keys of the buckets of each row: its bands (no steps), or each band with that so many steps on."""
    if not steps:
        return bands
    return np.concatenate([K.mix(bands + K.mix(np.roll(bands, -s, axis=1) + K.U64(s))) for s in steps], axis=1)


def own_order(keys: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    return K.mix(keys ^ nodes)


def elect(keys: np.ndarray, nodes: np.ndarray, ranks: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by bucket, the leader first; and which of them lead. The leader is the node of least rank; in
    one of `own` buckets it is the first in an order of the bucket's own."""
    order = np.lexsort((np.where(keys % K.U64(own) == 0, own_order(keys, nodes), ranks), keys))
    lead = np.ones(len(order), bool)
    lead[1:] = keys[order[1:]] != keys[order[:-1]]
    return order, lead


def sizes_of(lead: np.ndarray) -> np.ndarray:
    """For each row, the size of its bucket."""
    at = np.append(np.flatnonzero(lead), len(lead))
    return np.repeat(np.diff(at), np.diff(at))


def pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs of different nodes, the lesser first, and whether it is b, which may be in very many pairs."""
    low, high, swapped = np.minimum(a, b).view(np.int64), np.maximum(a, b).view(np.int64), b < a
    both = np.unique(np.stack([low, high, swapped])[:, low != high], axis=1) if len(low) else np.zeros((3, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(both[2].astype(bool))], ["a", "b", "swapped"])


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy().view(K.U64)


def _local(batches: Iterator[pa.RecordBatch], steps: tuple[int, ...], want_pairs: bool) -> Iterator[pa.RecordBatch]:
    """What a batch settles by itself: in its large buckets, pairs with the leader, who alone goes on. Members of
    its small buckets all go on."""
    own = OWN_ORDER * max(1, len(steps))
    for whole in batches:
        for lo in range(0, whole.num_rows, 4096):
            batch = whole.slice(lo, 4096)
            keys = bucket_keys(unsigned(batch.column(2).flatten()).reshape(-1, BANDS), steps)
            flat = keys.reshape(-1)
            owner, ranks = (np.repeat(unsigned(batch.column(k)), keys.shape[1]) for k in (0, 1))
            order, lead = elect(flat, owner, ranks, own)
            large = sizes_of(lead) > SMALL
            if want_pairs:
                first = order[lead]
                yield pairs_batch(owner[order][large], owner[first][np.cumsum(lead) - 1][large])
            else:
                on = order[lead | ~large]
                yield pa.RecordBatch.from_arrays([pa.array(x[on].view(np.int64)) for x in (flat, owner, ranks)], ["key", "node", "rank"])


def _between(batches: Iterator[pa.RecordBatch], own: int) -> Iterator[pa.RecordBatch]:
    """Rows ordered by bucket: pairs of small buckets' near neighbours, and of large ones' members and leaders. A
    bucket that goes on in the next batch hands it its leader, and up to SMALL rows."""
    none = tuple(np.zeros(0, K.U64) for _ in range(3))
    held = none
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes, ranks = (np.concatenate([h, unsigned(batch.column(k))]) for k, h in enumerate(held))
        last = keys[-1]
        order, lead = elect(keys, nodes, ranks, own)
        size = sizes_of(lead)
        first = order[lead]
        large = size > SMALL
        yield pairs_batch(nodes[order][large], nodes[first][np.cumsum(lead) - 1][large])
        rows = np.lexsort((own_order(keys, nodes), keys))
        k, v = keys[rows], nodes[rows]
        for d in range(1, NEIGHBOURS + 1):
            near = np.flatnonzero((k[d:] == k[:-d]) & ~large[d:])
            yield pairs_batch(v[near], v[near + d])
            # the order goes round: its last ones meet its first
            start = np.flatnonzero(lead)
            count = np.diff(np.append(start, len(lead)))
            for j in range(d):
                some = start[(count > d) & (count <= SMALL) & (count > NEIGHBOURS + 1)]
                sized = count[(count > d) & (count <= SMALL) & (count > NEIGHBOURS + 1)]
                yield pairs_batch(v[some + j], v[some + sized - d + j])
        open_rows = order[keys[order] == last][:SMALL]
        held = (keys[open_rows], nodes[open_rows], ranks[open_rows])


def candidates(signed: DataFrame, steps: tuple[int, ...] = ()) -> DataFrame:
    """Pairs a < b of nodes (signed: _node, _rank, _bands) that share a bucket and of which one leads it, a if swapped."""
    schema = "a long, b long, swapped boolean"
    own = OWN_ORDER * max(1, len(steps))
    rows = signed.select("_node", "_rank", "_bands")
    inside = C.arrow_map(rows, lambda it: _local(it, steps, True), schema)
    leaders = C.arrow_map(rows, lambda it: _local(it, steps, False), "key long, node long, rank long")
    n = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = C.arrow_map(leaders.repartition(n, "key").sortWithinPartitions("key"), lambda it: _between(it, own), schema)
    return inside.union(across)


def ranked(nodes: DataFrame) -> DataFrame:
    """nodes (_node, _bands) with _rank: the more others share a node's buckets, the less it is, so that what many
    are like leads. Told from some of the bands; equal ranks are ordered by node."""
    some = nodes.select("_node", F.explode(F.slice("_bands", 1, POPULAR_BANDS)).alias("key"))
    sizes = C.materialise(some.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    known = some.join(sizes, "key").groupBy("_node").agg(F.sum("n").alias("n"))
    rank = (F.lit((1 << 18) - 1) - F.least(F.coalesce("n", F.lit(0)), F.lit((1 << 18) - 1))) * F.lit(1 << 45) + F.shiftrightunsigned("_node", 19)
    return nodes.join(known, "_node", "left").select("_node", "_id", rank.alias("_rank"), "_bands")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard similarity of two sorted arrays of shingles with repetitions."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
    common = y[at] == x if len(y) else np.zeros(len(x), bool)
    if len(a) == len(x) and len(b) == len(y):
        both = int(common.sum())
        return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0
    p, q = n[common].astype(float), m[at[common]].astype(float)
    only_x, only_y = n.sum() - p.sum(), m.sum() - q.sum()
    total = 0.0
    for (u, v), times in zip(*np.unique(np.stack([p, q], axis=1), axis=0, return_counts=True), strict=True):
        total += times / (np.maximum(p / u, q / v).sum() + only_x / u + only_y / v)
    return float(total)


def filter_bits(candidates_of: DataFrame) -> np.ndarray:
    """A bit set for each (node, row) hash in the column h; FILTER_BITS bits, whatever the number of rows."""
    at = F.pmod(F.col("h"), F.lit(FILTER_BITS))
    words = candidates_of.groupBy(F.shiftright(at, 5).cast("int").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(h, {FILTER_BITS}) & 31 as int)))").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words.w.to_numpy(dtype=np.int64)] = words.bits.to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def row_hash(nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (K.mix(nodes.view(K.U64) ^ K.mix(ids.view(K.U64) + K.U64(1))) >> K.U64(1)).view(np.int64)


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(row_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy()))], ["h"])


def shingle_sets(needed: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """_node, _set: the sorted shingle hashes (with repetitions) of the nodes in needed (_node), one row for each, and
    of few others. nodes: _node, _id, one row of docs (_id, text) for each node. Rows of equal text and id (null ids
    are all equal) are sent once by each task, and of those one is kept."""
    hashed = C.arrow_map(nodes.join(needed, "_node").select("_node", "_id"), _hash_rows, "h long")
    sent = docs.sparkSession.sparkContext.broadcast(filter_bits(hashed))

    def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        seen: set[int] = set()
        for batch in batches:
            data, offsets = K.buffer_of(batch.column(0))
            ids = batch.column(1).to_numpy()
            for lo, hi, part, places in K.pieces(data, offsets, K.PIECE_BYTES):
                hashes, firsts, own = shingles(part, places)
                own = own.view(np.int64)
                at = row_hash(own, ids[lo:hi]) % FILTER_BITS
                keep = np.flatnonzero((bits[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1))
                keep = np.array([k for k in keep if own[k] not in seen and not seen.add(own[k])], np.int64)
                if len(keep):
                    found = [np.sort((hashes[firsts[k] : firsts[k + 1]] >> K.U64(32)).astype("<u4")).tobytes() for k in keep]
                    yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(found, pa.binary())], ["_node", "_set"])

    return C.arrow_map(docs.select("text", "_id"), shingle_rows, "_node long, _set binary").dropDuplicates(["_node"])


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b, swapped) with their exact similarity and whether it reaches the threshold. nodes: _node, _id, one
    row of docs (_id, text) for each node. The second set to be joined is the leader's, which may be in very many
    pairs: it is not shuffled again with each of them."""
    needed = pairs.select(F.col("a").alias("_node")).union(pairs.select(F.col("b").alias("_node"))).distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [similarity(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(values, pa.float64())], ["a", "b", "similarity"])

    sets = C.materialise(shingle_sets(needed, nodes, docs))
    turned = pairs.select(F.when(F.col("swapped"), F.col("b")).otherwise(F.col("a")).alias("m"), F.when(F.col("swapped"), F.col("a")).otherwise(F.col("b")).alias("l"))
    members = turned.join(sets.select(F.col("_node").alias("m"), F.col("_set").alias("x")), "m")
    both = members.join(sets.select(F.col("_node").alias("l"), F.col("_set").alias("y")), "l").select(F.least("m", "l").alias("a"), F.greatest("m", "l").alias("b"), "x", "y")
    compared = C.arrow_map(both, compare, "a long, b long, similarity double")
    return compared.withColumn("linked", F.col("similarity") >= threshold)


def settle(key: int, roots: np.ndarray, blocks: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links between the classes (roots) of a bucket's nodes: each two nodes are compared unless their classes are
    one by then, or an earlier band holds both, whose bucket compares them. Of two blocks, only nodes of different
    ones are compared."""
    _, label, sizes = np.unique(roots, return_inverse=True, return_counts=True)
    # the largest class stands last, so that its nodes find none after them that is not of it
    order = np.lexsort((label, sizes[label]))
    roots, blocks, bands, label, sets = roots[order], blocks[order], bands[order], label[order], [sets[k] for k in order]
    lengths = np.array([len(x) for x in sets])
    rows, values = np.repeat(np.arange(len(sets)), lengths), np.concatenate(sets)
    new = np.ones(len(values), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(new)
    weights = np.diff(np.append(at, len(values))).astype(np.float64)
    vocabulary, ids = np.unique(values[at], return_inverse=True)
    firsts = np.searchsorted(rows[at], np.arange(len(sets) + 1))
    counts = np.diff(firsts)
    plain, table, two = counts == lengths, np.zeros(len(vocabulary)), blocks.min() != blocks.max()
    links = []
    for i in range(len(sets)):
        others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if two:
            others = others[blocks[others] != blocks[i]]
        band = int(np.flatnonzero(bands[i] == key)[0])
        others = others[~(bands[others, :band] == bands[i, :band]).any(axis=1)]
        # sets of too different sizes are not alike
        sized = np.minimum(counts[others], counts[i]) >= threshold * np.maximum(counts[others], counts[i]) - 1e-6
        others = others[sized | ~(plain[others] & plain[i])]
        if not len(others):
            continue
        mine = slice(firsts[i], firsts[i + 1])
        table[ids[mine]] = weights[mine]
        ends = np.cumsum(counts[others])
        for part in np.split(others, np.flatnonzero(np.diff(ends // LOOKUPS)) + 1):
            part = part[label[part] != label[i]]
            if not len(part):
                continue
            start = np.cumsum(counts[part]) - counts[part]
            place = np.arange(counts[part].sum()) + np.repeat(firsts[part] - start, counts[part])
            held = table[ids[place]]
            both = np.add.reduceat((held > 0).astype(np.float64), start)
            value = both / (counts[part] + counts[i] - both)
            # with repetitions the shared mass is a bound, and what reaches it is compared exactly
            mixed = ~(plain[part] & plain[i])
            if mixed.any():
                bound = np.add.reduceat(np.minimum(held / lengths[i], weights[place] / np.repeat(lengths[part], counts[part])), start)
                for k in np.flatnonzero(mixed):
                    value[k] = similarity(sets[i], sets[part[k]]) if bound[k] >= threshold - 1e-6 else 0.0
            for j in part[value >= threshold]:
                if label[j] != label[i]:
                    links.append((int(roots[i]), int(roots[j])))
                    label[label == label[j]] = label[i]
        table[ids[mine]] = 0.0
    return links


def remaining(nodes: DataFrame, roots: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Links a, b between classes whose nodes share a band in a bucket of several classes that was not compared in
    full. nodes: _node, _id, _bands of those with words; roots: node, root.

    A bucket of more than BLOCK nodes is dealt in blocks, those of its most frequent class apart, and each block is
    held against each other one but for two of that class.
    """
    held = C.materialise(nodes.join(roots.withColumnRenamed("node", "_node"), "_node", "left").select("_node", F.coalesce("root", "_node").alias("_root"), "_id", "_bands"))
    spread = held.select("_node", "_root", F.explode("_bands").alias("key"))
    several = spread.groupBy("key").agg(F.count("*").alias("n"), F.min("_root").alias("low"), F.max("_root").alias("high"))
    several = C.materialise(several.where((F.col("n") > 2 * NEIGHBOURS + 1) & (F.col("low") != F.col("high"))).select("key", "n"))
    members = C.materialise(spread.join(several, "key"))
    shares = members.groupBy("key", "_root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "_root")).alias("most"))
    shares = shares.select("key", F.col("most.m").alias("m"), F.col("most._root").alias("main"))
    of_main, many = F.col("_root") == F.col("main"), F.col("n") > BLOCK
    few_blocks, main_blocks = F.ceil((F.col("n") - F.col("m")) / BLOCK), F.ceil(F.col("m") / BLOCK)
    deal = F.when(of_main, few_blocks + F.pmod(F.xxhash64("_node"), main_blocks)).otherwise(F.pmod(F.xxhash64("_node"), few_blocks))
    last = F.when(~many, F.lit(0)).when(of_main, few_blocks - 1).otherwise(few_blocks + main_blocks - 1)
    dealt = members.join(shares, "key").select("_node", "key", F.when(many, deal).otherwise(F.lit(0)).cast("long").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("other"))
    dealt = dealt.select("_node", "key", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    needed = C.materialise(members.select("_node").distinct())
    sets = shingle_sets(needed, nodes, docs)
    full = C.materialise(held.join(needed, "_node").join(sets, "_node").select("_node", "_root", "_bands", "_set"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_at, rows = None, []

        def found() -> pa.RecordBatch:
            links = np.array(settle(open_at[0], *(np.array(x) for x in list(zip(*rows))[:2]), np.stack([r[2] for r in rows]), [r[3] for r in rows], threshold), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

        for batch in batches:
            keys, bands = zip(*(batch.column(k).to_pylist() for k in range(3))), batch.column(5).flatten().to_numpy().reshape(-1, BANDS)
            roots, blocks = batch.column(4).to_numpy(), batch.column(3).to_numpy()
            for k, at in enumerate(keys):
                if at != open_at:
                    if rows:
                        yield found()
                    open_at, rows = at, []
                rows.append((roots[k], blocks[k], bands[k], np.frombuffer(batch.column(6)[k].as_py(), "<u4")))
        if rows:
            yield found()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.join(full, "_node").select("key", "p", "q", "block", "_root", "_bands", "_set")
    return C.arrow_map(dealt.repartition(n, "key", "p", "q").sortWithinPartitions("key", "p", "q"), compare, "a long, b long").distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, class_id (the least doc_id of the row's class) and class_key (a hash that tells
    classes apart where ids are null or repeated)."""
    last = (1 << 63) - 1
    source = docs.select("text", F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("_id"), F.struct(*[F.col(f"`{k}`") for k in keep]).alias("_kept"))
    signed = C.materialise(C.arrow_map(source, _sign, C.with_fields(source.schema[1:], "_node long, _bands array<long>")))
    nodes = signed.groupBy("_node").agg(F.min("_id").alias("_id"), F.any_value("_bands").alias("_bands"))
    nodes = C.materialise(ranked(C.materialise(nodes)))
    worded = nodes.where(F.size("_bands") > 0)
    pairs = C.materialise(candidates(worded).union(candidates(worded, NARROW)).dropDuplicates(["a", "b"]))
    links = verified(pairs, nodes, source.select("text", "_id"), threshold).where("linked").select("a", "b")
    roots = C.materialise(components(links))
    more = C.materialise(remaining(worded, roots, source.select("text", "_id"), threshold))
    if not more.isEmpty():
        whole = components(more.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        roots = C.materialise(whole)
    nodes = nodes.select("_node", "_id")
    named = nodes.join(roots.withColumnRenamed("node", "_node"), "_node", "left").withColumn("_root", F.coalesce("root", "_node"))
    names = named.groupBy("_root").agg(F.min("_id").alias("_class"))
    of_node = C.materialise(named.join(names, "_root").select("_node", "_class", F.col("_root").alias("class_key")))
    out = signed.drop("_bands").join(of_node, "_node")
    return out.select("_kept.*", F.when(F.col("_class") < last, F.col("_class")).alias("class_id"), "class_key")


def survivors(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class: that of the least doc_id, then of the least hash of its text."""
    rows = C.packed(docs)
    least = classes(rows, threshold, keep=C.ROW_KEY).groupBy("class_key").agg(F.min(F.struct(*C.ROW_KEY)).alias("_least"))
    least = least.select(*[F.col(f"_least.{k}").alias(k) for k in C.ROW_KEY])
    # equal rows have equal keys, and stand in one partition after the join: one of them stays
    return C.unpacked(rows.join(least, list(C.ROW_KEY), "left_semi").dropDuplicates(list(C.ROW_KEY)))
