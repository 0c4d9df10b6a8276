"""Readers of edge lists, attribute tables and saved results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRIBUTES = "node bigint, attributeType string, attributeVal string"
SELECTED = "attribute string, attributeType string, freq bigint, totalKnown bigint, relativeFreq double, rank bigint, percentile double"


def read_edges(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Undirected edges (src, dst) of a white-space separated text file, duplicates kept. Strict: a line that is
    not exactly two integers raises when it is read; otherwise further tokens are ignored and such lines go."""
    tokens = F.split(F.trim(F.col("value")), r"\s+")
    parsed = spark.read.text(path).where(F.trim("value") != "")
    parsed = parsed.select("value", F.size(tokens).alias("n"), F.try_element_at(tokens, F.lit(1)).try_cast("bigint").alias("src"), F.try_element_at(tokens, F.lit(2)).try_cast("bigint").alias("dst"))
    good = F.col("src").isNotNull() & F.col("dst").isNotNull()
    if not strict:
        return parsed.where(good).select("src", "dst")
    bad = F.raise_error(F.concat(F.lit("not an edge: "), F.col("value"))).cast("bigint")
    return parsed.select(F.when(good & (F.col("n") == 2), F.col("src")).otherwise(bad).alias("src"), "dst")


def read_attributes(spark: SparkSession, path: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """Attribute rows of a `;`-separated file with a header; empty values are dropped, as nulls are."""
    rows = spark.read.option("sep", ";").option("header", True).schema(ATTRIBUTES).csv(path).where("node is not null and attributeVal is not null")
    return rows if types is None else of_types(rows, types)


def of_types(attributes: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Rows of the given types; a type that does not occur raises."""
    there = {r.attributeType for r in attributes.where(F.col("attributeType").isin(*types)).select("attributeType").distinct().collect()}
    if missing := sorted(set(types) - there):
        raise ValueError(f"attribute types that do not occur: {missing}")
    return attributes.where(F.col("attributeType").isin(*types))


def read_selected(spark: SparkSession, path: str) -> DataFrame:
    """The table of selected attributes: quoted CSV with a header."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').schema(SELECTED).csv(path)


def load_object(spark: SparkSession, folder: str, name: str, extension: str = "parquet") -> DataFrame:
    """What save_object wrote."""
    if extension not in ("parquet", "csv"):
        raise ValueError(f"extension {extension!r}")
    reader = spark.read.option("header", True).option("inferSchema", True) if extension == "csv" else spark.read
    return getattr(reader, extension)(f"{folder}/{name}.{extension}")


def read_precision(spark: SparkSession, path: str) -> DataFrame | None:
    """Saved precision curves, or None where there are none."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if exists(spark, path) else None


def file_system(spark: SparkSession, path: str):
    """The file system that a path is in, of any that Spark reaches, and the path as it takes it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def listing(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder."""
    files, path = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


def exists(spark: SparkSession, path: str) -> bool:
    files, target = file_system(spark, path)
    return bool(files.exists(target))


def read_line(spark: SparkSession, path: str) -> str:
    """A small file of one line."""
    return spark.read.text(path).first()[0]
