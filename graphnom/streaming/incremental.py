"""Counts that grow with a stream: pair counts and value frequencies are sums, so each batch adds its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphnom.operators.cooccur import pair_counts
from graphnom.sources.readers import exists, listing
from graphnom.sources.writers import remove


class RunningCounts:
    """Counts by key in Parquet versions under a folder; a batch that is delivered again changes nothing."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], column: str):
        self.spark, self.folder, self.keys, self.column = spark, folder, keys, column

    def path(self, version: int) -> str:
        return f"{self.folder}/v{version}"

    def versions(self) -> list[int]:
        """The versions that were written to their end, rising."""
        found = [int(n[1:]) for n in listing(self.spark, self.folder) if n[:1] == "v" and n[1:].isdigit()]
        return sorted(v for v in found if exists(self.spark, f"{self.path(v)}/_SUCCESS"))

    def read(self, version: int) -> DataFrame | None:
        """The counts up to a batch, or of the last one before it that there is."""
        there = [v for v in self.versions() if v <= version]
        return self.spark.read.parquet(self.path(there[-1])) if there else None

    def add(self, counts: DataFrame, version: int) -> None:
        """Adds a batch. The version before stays, as the batch may be delivered again; older ones go."""
        before = self.read(version - 1)
        rows = counts if before is None else before.unionByName(counts)
        rows.groupBy(*self.keys).agg(F.sum(self.column).alias(self.column)).write.mode("overwrite").parquet(self.path(version))
        for old in [v for v in self.versions() if v < version][:-1]:
            remove(self.spark, self.path(old))


def stream_pair_counts(edges: DataFrame, values: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """edges: a stream of (src, dst). Keeps pair counts (a, b, c) under folder as edges arrive."""
    state = RunningCounts(values.sparkSession, folder, ["a", "b"], "c")
    return edges.writeStream.foreachBatch(lambda batch, k: state.add(pair_counts(batch, values), k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_frequencies(attributes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """attributes: a stream of (node, attributeType, attributeVal). Keeps value frequencies under folder."""
    state = RunningCounts(attributes.sparkSession, folder, ["type", "val"], "freq")

    def one(batch: DataFrame, k: int) -> None:
        state.add(batch.groupBy(F.col("attributeType").alias("type"), F.col("attributeVal").alias("val")).agg(F.count("*").alias("freq")), k)

    return attributes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
