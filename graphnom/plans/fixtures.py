"""Graph, attribute and feature views of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphnom.operators import graph

from .tables import materialise


class Fixtures:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._kept: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def nodes(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("node"))

    def edges(self) -> DataFrame:
        """Parts of one order, each two once for each order and line."""
        lines = self.table("lineitem").select("l_orderkey", "l_partkey")
        other = lines.select("l_orderkey", F.col("l_partkey").alias("dst"))
        return lines.join(other, "l_orderkey").where("l_partkey < dst").select(F.col("l_partkey").alias("src"), "dst")

    def kept_edges(self) -> DataFrame:
        """edges, joined once and written, for what reads them more than once."""
        if self._kept is None:
            self._kept = materialise(self.edges())
        return self._kept

    def kept_adjacency(self) -> DataFrame:
        return materialise(graph.adjacency(self.kept_edges()))

    def attributes(self) -> DataFrame:
        """node, attributeType, attributeVal of five types, each with missing nodes."""
        part = self.table("part")
        key = F.col("p_partkey")
        kinds = [("brand", F.array("p_brand"), key % 5 != 0), ("word", F.split("p_name", " "), key % 7 != 0), ("ptype", F.array("p_type"), key % 3 != 0), ("size", F.array(F.col("p_size").cast("string")), key % 11 != 0), ("retailprice", F.array(F.col("p_retailprice").cast("string")), key % 11 != 0)]
        none = F.array().cast("array<struct<attributeType:string,attributeVal:string>>")

        def typed(kind: str, values: Column, there: Column) -> Column:
            return F.when(there, F.transform(values, lambda v: F.struct(F.lit(kind).alias("attributeType"), v.alias("attributeVal")))).otherwise(none)

        rows = F.concat(*[typed(*k) for k in kinds])
        return part.select(key.alias("node"), F.explode(rows).alias("r")).select("node", "r.attributeType", "r.attributeVal")

    def values(self, kind: str) -> DataFrame:
        """node, val: distinct values of one type."""
        return self.attributes().where(F.col("attributeType") == kind).select("node", F.col("attributeVal").alias("val")).distinct()

    def features(self) -> DataFrame:
        """node, features, ind: 1 if the label is 2, known where the id is no multiple of 4."""
        rows = self.table("embeddings")
        known = F.when(F.col("vec_id") % 4 != 0, F.when(F.col("label") == 2, 1.0).otherwise(0.0))
        return rows.select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("features"), known.alias("ind"))

    def bipartite(self) -> DataFrame:
        customers = self.table("customer").agg(F.max("c_custkey")).first()[0] + 1
        joined = self.table("orders").join(self.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        return joined.select(F.col("o_custkey").alias("src"), (F.lit(customers) + F.col("l_partkey")).alias("dst"))
