"""Ranks and running sums without a task that holds a whole group: rows are dealt into ranges of their order, each range
is summed alone, and what the ranges before it hold is added."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphnom.plans.tables import materialise


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], by: tuple[str, ...] = (), rank: str = "rank") -> DataFrame:
    """rows with their rank (from 1) in an order that tells all of them apart, and running sums up to each, within `by`
    if given. Sums: names and what is summed.

    The rows are written once, in ranges of (by, order). A group may lie in many ranges and a range may hold many
    groups; the table of ranges has as many rows as there are ranges and groups together.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = {f"_add_{name}": what for name, what in sums.items()}
    dealt = materialise(rows.withColumns(added).repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()))
    held = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"), *[F.sum(a).alias(f"_sum{a}") for a in added])
    held = materialise(held)
    here, before = held.select(*by, "_range"), held.select(*[F.col(c).alias(f"_b_{c}") for c in held.columns])
    earlier = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by], F.col("_b__range") < F.col("_range"))
    firsts = here.join(before, earlier, "left").groupBy(*by, "_range").agg(
        F.coalesce(F.sum("_b__n"), F.lit(0)).alias("_first"), *[F.sum(f"_b__sum{a}").alias(f"_before{a}") for a in added]
    )
    firsts = firsts.select(*[F.col(c).alias(f"_f_{c}") for c in (*by, "_range")], "_first", *[f"_before{a}" for a in added])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in by], F.col("_range") == F.col("_f__range"))
    placed = dealt.join(firsts, same)
    own = Window.partitionBy(*by, "_range").orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    # a sum over nulls alone is null, as it is over a whole group
    totals = {name: F.when(F.sum(a).over(so_far).isNull(), F.col(f"_before{a}")).otherwise(F.sum(a).over(so_far) + F.coalesce(F.col(f"_before{a}"), F.lit(0))) for name, a in zip(sums, added, strict=True)}
    return placed.select(*rows.columns, (F.row_number().over(own) + F.col("_first")).alias(rank), *[t.alias(name) for name, t in totals.items()])
