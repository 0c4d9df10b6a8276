"""Mixing sources to target weights by subset-sum budget fitting.

Sources, by code point with null last, weigh 3, 1, 2 in turn and share a budget of 150 % of all words; a target
stops at twice its source's size and the excess is reshared by weight. Within a source every document is first
taken as often as fits for all, then the rest of the target is filled: documents are counted by exact length, a
proportional part of each length is taken, and what remains of the budget is fitted by a bounded-knapsack
dynamic program over the lengths left. Which documents of a length are taken goes by a seeded hash.

Texts never move: only (source, length, slice) counts do. A slice is the top of the seeded hash, so the order
by hash runs over slices, and a length that a third of all rows share is ranked in many tasks.

Defined cases: a null or wordless text has length 0 and is never picked; it stands as often as its whole source is
taken, with 0 words. Null sources form one source that stands last; of two sums equally near the budget the lesser is
taken; a very long text is one document of its length, and the program's table does not grow with it; an empty table
gives an empty result; rows with equal doc_id and hash are ordered by a row id of their own, each row is mixed by
itself; extra columns are ignored unless in `keep`. One row for each source is brought together in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
MOST_TIMES = 2
SEED = 20240229
#: Slices of the seeded hash: a hot length of n rows is ranked in parts of n / SLICES rows.
SLICES = 1 << 12
#: Words of a budget that are left to the dynamic program: its table has twice as many places, whatever the source's
#: size and its longest text.
TABLE = 1 << 17


def sizes(docs: DataFrame) -> DataFrame:
    """Adds size: the number of words of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("size", F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = BUDGET_PERCENT) -> DataFrame:
    """sources: key, source, source_size, one row each. Adds target.

    Resharing by weight until no source is above its cap ends at target = min(cap, level * weight); the capped
    sources are those of least cap for their weight, so running sums in that order give the level.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_ratio = Window.orderBy("_ratio", "key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sources.withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(MOST_TIMES)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    left = F.sum("source_size").over(everything) * (percent / 100.0) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    t = t.withColumn("_level", left / weight_left)
    # the first source in this order whose cap is not reached sets the level for it and all after it
    t = t.withColumn("_open", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "key", "_level"))).over(everything))
    above = F.col("_open").isNotNull() & (F.struct("_ratio", "key") >= F.struct(F.col("_open._ratio"), F.col("_open.key")))
    return t.select("key", "source", "source_size", F.when(above, F.col("_w") * F.col("_open._level")).otherwise(F.col("_cap")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int = TABLE) -> np.ndarray:
    """How many of the counts[i] documents of lengths[i] to take so that their words come nearest to the budget
    (from below on a tie). Lengths are positive and distinct.

    What goes beyond `table` words is taken in proportion from all lengths, then in whole lengths, the longest that fits
    first. The rest, at most `table` words unless every document left is longer than it, is fitted exactly.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    budget = max(0, min(budget, total))
    if not len(lengths) or budget == 0:
        return np.zeros(len(lengths), np.int64)
    taken = np.floor(counts * max(0.0, (budget - table) / total)).astype(np.int64)
    rest = budget - int((lengths * taken).sum())
    room = counts - taken
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= table:
            break
        # as many as leave the program its words; one more if they are not enough
        more = min(int(room[i]), -(-(rest - table) // int(lengths[i])), rest // int(lengths[i]))
        taken[i] += more
        room[i] -= more
        rest -= more * int(lengths[i])
    # sums above twice the rest are farther from it than taking nothing
    limit = 2 * rest
    usable = np.flatnonzero((lengths <= limit) & (room > 0))
    if rest > table:  # every document left is longer than the rest: one of them, or none
        one = usable[lengths[usable] < limit]
        if len(one):
            taken[one[lengths[one].argmin()]] += 1
        return taken
    reach, mask = 1, (1 << (limit + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    first = np.zeros(limit + 1, np.int32)  # the step that first reached each sum
    for i in usable:
        left, unit = min(int(room[i]), limit // int(lengths[i])), 1
        while left > 0:
            n = min(unit, left)
            words = n * int(lengths[i])
            new = (reach << words) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(limit // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(steps)
                steps.append((int(i), n, words))
                reach |= new
            left -= n
            unit *= 2
        if reach >> rest & 1:
            break
    low = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> rest
    high = rest + (above & -above).bit_length() - 1 if above else None
    at = high if high is not None and high - rest < rest - low else low
    while at:
        i, n, words = steps[first[at]]
        taken[i] += n
        at -= words
    return taken


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size")
    lengths, counts = group["size"].to_numpy(), group["n"].to_numpy()
    total, target = int((lengths * counts).sum()), float(group["target"].iloc[0])
    full = min(int(target // total), MOST_TIMES) if total else 0
    positive = lengths > 0
    picked = np.zeros(len(lengths), np.int64)
    if full < MOST_TIMES:
        picked[positive] = fit(lengths[positive], counts[positive], int(round(target - full * total)))
    return pd.DataFrame({"key": group["key"], "size": lengths, "times": full, "picked": picked})


def mix(docs: DataFrame, source: str = "source", keep: tuple[str, ...] = ("doc_id",), seed: int = SEED) -> DataFrame:
    """The columns in `keep` (which name what orders the rows first: doc_id), size, source_size, target, times
    (how often the mix has the document) and taken (words)."""
    key = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    rows = sizes(docs.select(*keep, "text", F.col(source).cast("string").alias("_source"), key.alias("_key"))).drop("text")
    draw = F.xxhash64(F.col(keep[0]), F.lit(seed))
    rows = C.materialise(rows.withColumn("_draw", draw).withColumn("_slice", F.shiftrightunsigned("_draw", 64 - (SLICES.bit_length() - 1)).cast("int")).withColumn("_row", F.monotonically_increasing_id()))
    # signed hashes order within a slice as unsigned ones do: the slice is their top, sign included
    cells = rows.groupBy("_key", "_source", "size", "_slice").agg(F.count("*").alias("n"))
    lengths = cells.groupBy("_key", "_source", "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy(F.col("_key").alias("key"), F.col("_source").alias("source")).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = C.materialise(targets(sources))
    C.ship_package(docs.sparkSession)
    plan = lengths.select(F.col("_key").alias("key"), "size", "n").join(aims.select("key", "target"), "key").groupBy("key").applyInPandas(_plan, "key string, size long, times int, picked long")
    before = Window.partitionBy("_key", "size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_key", "size", "_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    planned = cells.join(plan.withColumnRenamed("key", "_key"), ["_key", "size"])
    planned = planned.join(aims.select(F.col("key").alias("_key"), "source_size", "target"), "_key")
    rank = F.row_number().over(Window.partitionBy("_key", "size", "_slice").orderBy("_draw", keep[0], "_row"))
    out = rows.withColumn("_rank", rank).join(planned, ["_key", "size", "_slice"])
    times = F.col("times") + F.when(F.col("_rank") + F.col("_before") <= F.col("picked"), 1).otherwise(0)
    return out.select(*keep, "size", "source_size", "target", times.cast("int").alias("times"), (times * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, source: str = "source", seed: int = SEED) -> DataFrame:
    """docs as the mix takes them: each row as many times as it is taken."""
    rows = C.packed(docs)
    taken = mix(rows, source, keep=C.ROW_KEY, seed=seed).groupBy(*C.ROW_KEY).agg(F.sum("times").cast("int").alias("_times"))
    one = rows.join(taken.where("_times > 0"), list(C.ROW_KEY)).dropDuplicates(list(C.ROW_KEY))
    return C.unpacked(one.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))))
