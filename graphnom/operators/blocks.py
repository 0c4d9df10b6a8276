"""Blocks of vectors as dense arrays, and sparse matrices in tiles, multiplied in Arrow.

A block of `width` vectors over the ids 0 to n - 1 is a table (b, x): one row for each TILE ids, x their values as
float64, row by row; ids past n hold zeros. A product is made of parts (b, at, x): contributions to some rows of a block,
at their places within it (int32; null: all of them in order). Parts are summed when a block is asked for, so that the
sum of operators is a union. How many rows are joined and shuffled does not depend on the width.

A matrix is dealt into tiles (bj, slice): the entries of the columns of one block, in slices of about SLICE entries, so
that a column of many entries is spread and its block is sent to each of its slices. A tile meets its block in a join;
what leaves a task is one part for each block of rows that the tile reaches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphnom.plans.shipping import ship_package
from graphnom.plans.tables import materialise

#: Ids of a block, and about how many entries of a matrix a tile holds.
TILE, SLICE = 2048, 1 << 16
BATCH = 16 << 20
#: Bytes of a block up to which it is broadcast to the tiles, and of small matrices that the driver adds up itself.
SENT = 32 << 20
PARTS = "b long, at binary, x binary"
PART_SCHEMA = pa.schema([("b", pa.int64()), ("at", pa.binary()), ("x", pa.binary())])


def mapped(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def numbers(raw: bytes | pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, width)


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of Arrow batches; binary values are views, not copies."""
    for batch in batches:
        own = [batch.column(c) for c in columns]
        for k in range(batch.num_rows):
            yield tuple(c[k].as_buffer() if isinstance(c, (pa.BinaryArray, pa.LargeBinaryArray)) and c[k].is_valid else c[k].as_py() for c in own)


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most 4,096 rows or some BATCH bytes."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) == 4096 or size > BATCH:
            yield flush()
            size = 0
    if held:
        yield flush()


# --- tables of vectors -------------------------------------------------------------------------------------------


def pack(vectors: DataFrame, width: int) -> DataFrame:
    """(id, col, x), zeros left out, as a block."""
    lists = vectors.groupBy(F.floor(F.col("id") / TILE).cast("long").alias("b")).agg(
        F.collect_list((F.col("id") % TILE).cast("int")).alias("at"), F.collect_list(F.col("col").cast("int")).alias("col"), F.collect_list(F.col("x").cast("double")).alias("x")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every():
            for batch in batches:
                for k in range(batch.num_rows):
                    full = np.zeros((TILE, width))
                    np.add.at(full, (batch["at"][k].values.to_numpy(), batch["col"][k].values.to_numpy()), batch["x"][k].values.to_numpy())
                    yield batch["b"][k].as_py(), full.tobytes()

        return batched(every(), pa.schema([("b", pa.int64()), ("x", pa.binary())]))

    return mapped(lists.select("b", "at", "col", "x"), run, "b long, x binary")


def unpack(block: DataFrame, width: int) -> DataFrame:
    """A block as (id, col, x), zeros left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in rows_of(batches, "b", "x"):
            full = numbers(x, width)
            at, col = np.nonzero(full)
            yield pa.RecordBatch.from_arrays([pa.array(at + b * TILE), pa.array(col), pa.array(full[at, col])], ["id", "col", "x"])

    return mapped(block.select("b", "x"), run, "id long, col long, x double")


def as_rows(block: DataFrame, width: int, n: int) -> DataFrame:
    """A block as (id, x array<double>), one row for each id that it has a row of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in rows_of(batches, "b", "x"):
            full = numbers(x, width)[: n - b * TILE]
            offsets = np.arange(len(full) + 1, dtype=np.int32) * width
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(full)) + b * TILE), pa.ListArray.from_arrays(pa.array(offsets), pa.array(full.reshape(-1)))], ["id", "x"])

    return mapped(block.select("b", "x"), run, "id long, x array<double>")


def dealt(spark: SparkSession, n: int, width: int, seed: int) -> DataFrame:
    """A block of numbers between -1 and 1 that depend on the seed alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every():
            for (b,) in rows_of(batches, "b"):
                full = np.random.default_rng([seed, b]).uniform(-1, 1, (TILE, width))
                full[max(n - b * TILE, 0) :] = 0
                yield b, full.tobytes()

        return batched(every(), pa.schema([("b", pa.int64()), ("x", pa.binary())]))

    return mapped(spark.range(-(-n // TILE)).withColumnRenamed("id", "b"), run, "b long, x binary")


def transformed(rows: DataFrame, function: Callable[..., np.ndarray], widths: dict[str, int]) -> DataFrame:
    """Parts (b, at, x) by a function of the arrays in some columns, row by row; at is kept where there is one."""
    columns = list(widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every():
            for b, at, *raw in rows_of(batches, "b", "at", *columns):
                made = function(*[numbers(r, w) for r, w in zip(raw, widths.values(), strict=True)])
                yield b, at if at is None else at.to_pybytes(), made.tobytes()

        return batched(every(), PART_SCHEMA)

    own = rows if "at" in rows.columns else rows.withColumn("at", F.lit(None).cast("binary"))
    return mapped(own.select("b", "at", *columns), run, PARTS)


def rotated(block: DataFrame, w: np.ndarray) -> DataFrame:
    """A W for a small matrix W."""
    return transformed(block, lambda x: x @ w, {"x": len(w)}).select("b", "x")


def ranges(spark: SparkSession, n: int) -> int:
    """Partitions for a block over n ids: some rows each, no more than the session's shuffles have."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (4 * TILE))))


def summed(parts: DataFrame, width: int, n: int) -> DataFrame:
    """The block over n ids that parts sum up to: one shuffle by block, each summed as its parts stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every():
            last, full = None, None
            for b, at, x in rows_of(batches, "b", "at", "x"):
                if b != last:
                    if full is not None:
                        yield last, full.tobytes()
                    last, full = b, np.zeros((TILE, width))
                add(full, at, x, width)
            if full is not None:
                yield last, full.tobytes()

        return batched(every(), pa.schema([("b", pa.int64()), ("x", pa.binary())]))

    return mapped(parts.select("b", "at", "x").repartition(ranges(parts.sparkSession, n), "b").sortWithinPartitions("b"), run, "b long, x binary")


def add(full: np.ndarray, at, x, width: int) -> None:
    if at is None:
        full += numbers(x, width)
    else:  # places of a part are distinct
        full[np.frombuffer(at, np.int32)] += numbers(x, width)


def shifted(parts: DataFrame, offset: int, n: int, width: int) -> DataFrame:
    """Parts with offset added to their ids; those outside 0 to n - 1 are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every():
            for b, at, x in rows_of(batches, "b", "at", "x"):
                full = numbers(x, width)
                ids = b * TILE + (np.arange(len(full)) if at is None else np.frombuffer(at, np.int32)) + offset
                good = (ids >= 0) & (ids < n)
                for to in np.unique(ids[good] // TILE).tolist():
                    own = good & (ids // TILE == to)
                    yield to, (ids[own] - to * TILE).astype(np.int32).tobytes(), full[own].tobytes()

        return batched(every(), PART_SCHEMA)

    own = parts if "at" in parts.columns else parts.withColumn("at", F.lit(None).cast("binary"))
    return mapped(own.select("b", "at", "x"), run, PARTS)


def column_sums(rows: DataFrame, function: Callable[..., np.ndarray], widths: dict[str, int], shape: tuple[int, int]) -> DataFrame:
    """One row (s): the sum of a small matrix over all rows, each made of the arrays in some columns. A task sends one
    matrix on; they are added as they stream by."""
    columns = list(widths)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for raw in rows_of(batches, *columns):
            total += function(*[numbers(r, w) for r, w in zip(raw, widths.values(), strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    return total_of(mapped(rows.select(*columns), partial, "s binary"), shape)


def total_of(sums: DataFrame, shape: tuple[int, int]) -> DataFrame:
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for (s,) in rows_of(batches, "s"):
            out += numbers(s, shape[1])
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["s"])

    return mapped(sums.select("s").repartition(1), total, "s binary")


def small(sums: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of small matrices (s), on the driver: added there if they are few, else by a task."""
    if shape[0] * shape[1] * 8 * sums.rdd.getNumPartitions() > SENT:
        sums = total_of(sums, shape)
    return sum((np.frombuffer(r[0], np.float64).reshape(shape) for r in sums.collect()), np.zeros(shape))


def outer(u: DataFrame, sums: DataFrame, width: int) -> DataFrame:
    """Parts u s: the block (b, u) of one vector times the one row of sums."""
    return transformed(u.crossJoin(F.broadcast(sums)), lambda u, s: u * s, {"u": 1, "s": width})


# --- matrices ----------------------------------------------------------------------------------------------------


@dataclass
class Tiles:
    """entries: bj, slice, i array<long>, j array<int> (within the block), v array<double>; slices: bj, slices."""

    entries: DataFrame
    slices: DataFrame


def tiled(matrix: DataFrame) -> Tiles:
    """matrix: i, j, v."""
    bj = F.floor(F.col("j") / TILE).cast("long").alias("bj")
    slices = materialise(matrix.groupBy(bj).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")))
    rows = matrix.select(bj, F.col("i").cast("long").alias("i"), (F.col("j") % TILE).cast("int").alias("j"), F.col("v").cast("double").alias("v")).join(slices, "bj")
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("i"), F.col("slices")).cast("int"))
    entries = rows.groupBy("bj", "slice").agg(*[F.collect_list(c).alias(c) for c in ("i", "j", "v")])
    return Tiles(materialise(entries), slices)


def multiplied(tiles: Tiles, x: DataFrame, width: int, n: int) -> DataFrame:
    """Parts of the product of a matrix with a block over n ids. A block of at most SENT bytes is broadcast; of a larger
    one, each row is sent to the slices of its tiles."""
    if -(-n // TILE) * TILE * width * 8 <= SENT:
        rows = tiles.entries.join(F.broadcast(x.select(F.col("b").alias("bj"), "x")), "bj").select("i", "j", "v", "x")
    else:
        sent = x.join(tiles.slices, F.col("b") == F.col("bj")).select("bj", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "x")
        rows = tiles.entries.join(sent, ["bj", "slice"]).select("i", "j", "v", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every():
            for batch in batches:
                for k in range(batch.num_rows):
                    i, j, v = (batch[c][k].values.to_numpy() for c in ("i", "j", "v"))
                    order = np.argsort(i, kind="stable")
                    i = i[order]
                    full = numbers(batch["x"][k].as_buffer(), width)
                    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                    sums = np.add.reduceat(v[order, None] * full[j[order]], first, axis=0)
                    ids = i[first]
                    cut = np.flatnonzero(np.concatenate([[True], ids[1:] // TILE != ids[:-1] // TILE]))
                    for lo, hi in zip(cut, [*cut[1:], len(ids)], strict=True):
                        to = int(ids[lo]) // TILE
                        yield to, (ids[lo:hi] - to * TILE).astype(np.int32).tobytes(), sums[lo:hi].tobytes()

        return batched(every(), PART_SCHEMA)

    return mapped(rows, run, PARTS)


# --- several blocks side by side ---------------------------------------------------------------------------------


def beside(parts: DataFrame | None, blocks: list[DataFrame], n: int) -> DataFrame:
    """Parts (place -1) and blocks over n ids (their place in the list), by b and place, each b within one partition."""
    none = F.lit(None).cast("binary").alias("at")
    rows = [x.select("b", F.lit(k).alias("place"), none, "x") for k, x in enumerate(blocks)]
    if parts is not None:
        at = F.col("at") if "at" in parts.columns else none
        rows.insert(0, parts.select("b", F.lit(-1).alias("place"), at, "x"))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.repartition(ranges(out.sparkSession, n), "b").sortWithinPartitions("b", "place")


def gathered(batches: Iterator[pa.RecordBatch], width: int, turns: list[np.ndarray], tile: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray | None]]]:
    """Of rows as `beside` deals them, for each b: the sum of its parts, and its rows of each block times
    that block's small matrix (None: zeros)."""
    last, full, own = None, np.zeros((tile, width)), [None] * len(turns)
    for b, place, at, x in rows_of(batches, "b", "place", "at", "x"):
        if b != last:
            if last is not None:
                yield last, full, own
            last, full, own = b, np.zeros((tile, width)), [None] * len(turns)
        if place < 0:
            add(full, at, x, width)
        else:
            own[place] = numbers(x, len(turns[place])) @ turns[place]
    if last is not None:
        yield last, full, own


OUT = "b long, x binary, s binary"
OUT_SCHEMA = pa.schema([("b", pa.int64()), ("x", pa.binary()), ("s", pa.binary())])


def with_sums(rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch], np.ndarray], Iterator[tuple[int, np.ndarray]]], shape: tuple[int, int]) -> tuple[DataFrame, np.ndarray]:
    """The block that a function makes of rows, written, and a small matrix that it has summed up on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)

        def every():
            for b, x in function(batches, total):
                yield b, x.tobytes(), None
            yield None, None, total.tobytes()

        return batched(every(), OUT_SCHEMA)

    out = materialise(mapped(rows, run, OUT))
    block = out.where("b is not null").select("b", "x")
    block._written = out._written
    return block, small(total_of(out.where("s is not null"), shape), shape)
