"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from graphnom.plans.shipping import ship_package
from graphnom.plans.tables import few_parts, materialise  # noqa: F401

#: The characters that separate words: space and U+0009 to U+000D. Nothing else does.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_bucket(column: str, modulus: int):
    """crc32 of the column as text, modulo; null hashes as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def with_fields(fields: Iterable[StructField], more: str) -> StructType:
    """A schema of fields, of any names, and of those of a DDL string."""
    return StructType([*fields, *StructType.fromDDL(more).fields])


#: Spark's setting of the bytes of a batch, and its default.
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Most bytes of rows that go to a Python worker at once: they are held on both sides, and again for the next batch.
BATCH_BYTES = 4 << 20


def arrow_map(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """mapInArrow with this package present on the executors, by batches of at most BATCH_BYTES (or one row)."""
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(BATCH_SETTING, None) in (None, BATCH_DEFAULT):  # a size that the user has set holds
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()  # else kept for a later task

    return df.mapInArrow(run, schema)


def text_first(df: DataFrame, column: str, keep: tuple[str, ...]) -> DataFrame:
    """_text: the column; _kept: those of `keep` in one struct, so that they may have any names."""
    return df.select(F.col(column).alias("_text"), F.struct(*[F.col(f"`{k}`") for k in keep]).alias("_kept"))


def arrow_map_kept(rows: DataFrame, function, more: str) -> DataFrame:
    """arrow_map of text_first's rows by a function that adds the columns of a DDL string to all but the first."""
    new = [f"`{f.name}`" for f in StructType.fromDDL(more)]
    return arrow_map(rows, function, with_fields(rows.schema[1:], more)).select("_kept.*", *new)


#: Columns that tell rows apart, where doc_id may be null or repeated: equal for rows that are equal in all columns.
ROW_KEY = ("_key_id", "_key_text")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and source, the row key, and the whole row as one struct `_doc`: its columns may have any names,
    those that operators use for themselves too."""
    last = (1 << 63) - 1
    maps = [f.name for f in docs.schema if "map<" in f.dataType.simpleString()]  # have no hash: hashed as written
    own = [F.to_json(f"`{f.name}`") if f.name in maps else F.col(f"`{f.name}`") for f in docs.schema]
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        "doc_id",
        "text",
        *[c for c in ("source",) if c in docs.columns],
        F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("_key_id"),
        F.xxhash64(*own).alias("_key_text"),
    )


def unpacked(docs: DataFrame) -> DataFrame:
    return docs.select("_doc.*")
