"""Frequencies, ranks and indicators of an attribute table (node, attributeType, attributeVal)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import mapped
from .ranges import running


class Attributes:
    """The tables that describe an attribute table."""

    def __init__(self, rows: DataFrame, types: tuple[str, ...] | None = None):
        self.rows = rows if types is None else rows.where(F.col("attributeType").isin(*types))

    def frequencies(self) -> DataFrame:
        """type, val, freq; repeated rows count."""
        return self.rows.groupBy(F.col("attributeType").alias("type"), F.col("attributeVal").alias("val")).agg(F.count("*").alias("freq"))

    def totals(self) -> DataFrame:
        """type, n_values (distinct), n_instances. Over the frequencies, so that a hot type is combined first."""
        return self.frequencies().groupBy("type").agg(F.count("*").alias("n_values"), F.sum("freq").alias("n_instances"))

    def nodes(self) -> DataFrame:
        return self.rows.select("node").distinct()

    def values(self) -> DataFrame:
        """type, node, val: each value of a node once."""
        return self.rows.select(F.col("attributeType").alias("type"), "node", F.col("attributeVal").alias("val")).distinct()

    def value_sets(self) -> DataFrame:
        """type, node, vals: the sorted values of each node."""
        return self.rows.groupBy(F.col("attributeType").alias("type"), "node").agg(F.array_sort(F.collect_set("attributeVal")).alias("vals"))

    def ranked(self, rank_thresh: int | None = 100) -> DataFrame:
        """type, rank (from 0), val, freq, cumulative_pct: values by falling frequency, then by value; the first
        rank_thresh of each type, or as many as there are (None: all)."""
        out = self.summed().select("type", (F.col("rank") - 1).cast("int").alias("rank"), "val", "freq", (100.0 * F.col("so_far") / F.col("n_instances")).alias("cumulative_pct"))
        return out if rank_thresh is None else out.where(F.col("rank") < rank_thresh)

    def summed(self) -> DataFrame:
        """type, val, freq, rank (from 1), so_far and n_instances: how many rows the values up to this one have, and all."""
        ranked = running(self.frequencies().select("type", "val", "freq"), [F.desc("freq"), F.col("val")], {"so_far": F.col("freq")}, ("type",))
        return ranked.join(self.totals().select("type", "n_instances"), "type")

    def report(self, rank_thresh: int = 100) -> DataFrame:
        """line, value: a banner, the totals and the ranked values of each type."""
        head = self.totals().select("type", F.lit(-2).alias("at"), F.format_string("=== %s ===", "type").alias("value"))
        total = self.totals().select("type", F.lit(-1).alias("at"), F.format_string("%d values, %d instances", "n_values", "n_instances").alias("value"))
        top = mapped(self.ranked(rank_thresh).select("type", "rank", "val", "freq", "cumulative_pct"), report_lines, "type string, at int, value string")
        rows = head.unionByName(total).unionByName(top)
        return rows.select((F.row_number().over(Window.orderBy("type", "at")) - 1).alias("line"), "value")

    def indicator(self, nodes: DataFrame, kind: str, value: str) -> DataFrame:
        """node, ind: 1 if a node has the value, 0 if it has only others of the type, null if it has none."""
        own = self.rows.where(F.col("attributeType") == kind).groupBy("node").agg(F.max(F.when(F.col("attributeVal") == value, 1.0).otherwise(0.0)).alias("ind"))
        return nodes.join(own, "node", "left")

    def selected_stats(self) -> DataFrame:
        """Each value's share of its type's instances, its rank from 1 and the running share."""
        known = self.values().groupBy("type").agg(F.count_distinct("node").alias("total_known"))
        out = self.summed().select("type", "val", "freq", (F.col("freq") / F.col("n_instances")).alias("relative_freq"), F.col("rank").cast("int").alias("rank"), (F.col("so_far") / F.col("n_instances")).alias("percentile"))
        return out.join(known, "type")


def report_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of ranked values. C's %.4f rounds the number as it is held, to even where it lies half way; Java's rounds
    its shortest decimal form up, so 29.36875, held as a little less, would come out as 29.3688."""
    for batch in batches:
        rows = zip(*[batch[c].to_pylist() for c in ("rank", "val", "freq", "cumulative_pct")], strict=True)
        lines = [None if None in r else "%d\t%s\t%d\t%.4f" % r for r in rows]
        yield pa.RecordBatch.from_arrays([batch["type"], batch["rank"], pa.array(lines, pa.string())], ["type", "at", "value"])


def log_ranks(ranked: DataFrame) -> DataFrame:
    """What a log-log rank plot draws: log10 of the rank from 1 and of the frequency."""
    return ranked.select("type", "val", F.log10(F.col("rank") + 1.0).alias("log_rank"), F.log10(F.col("freq").cast("double")).alias("log_freq"))


def seed_counts(indicator: DataFrame) -> DataFrame:
    """n_true, n_false, n_unknown, guess_rate (share of seeds that are true)."""
    return indicator.agg(
        F.count_if(F.col("ind") == 1).alias("n_true"),
        F.count_if(F.col("ind") == 0).alias("n_false"),
        F.count_if(F.col("ind").isNull()).alias("n_unknown"),
        F.avg("ind").alias("guess_rate"),
    )


def check_seeds(indicator: DataFrame) -> tuple[int, int]:
    """Both classes need more than one seed."""
    row = seed_counts(indicator).first()
    if row.n_true < 2 or row.n_false < 2:
        raise ValueError(f"{row.n_true} true and {row.n_false} false seeds; two of each are needed")
    return row.n_true, row.n_false
