"""The corpus pipeline: quality rules, near-dedup, secret scan, mixing, tokenizing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphnom.llm import common as C
from graphnom.llm import mixing, near_dedup, pieces, secret_scan
from graphnom.llm.quality import quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; rows are judged one by one, so equal rows stay or go together.
    Null, empty and wordless texts fail the base rule; an empty table stays empty; columns of any names are kept."""
    labels = C.table(spark, sf_dir, "labels")
    return C.few_parts(C.unpacked(quality(C.packed(docs), labels.where("quality = 1"), labels.where("quality = 0"), keep=("_doc",)).where("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that of the least doc_id (null ids last; of equal ids the
    least hash of the row). Null and wordless texts are one class; of equal rows one stays; an empty table stays empty."""
    return C.few_parts(near_dedup.survivors(docs))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks, n_chars is the new length; every row stays. A null text stays null; equal rows
    are changed alike; of overlapping values the first is replaced whole; an empty table stays empty."""
    return C.few_parts(secret_scan.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row stands as often as the mix takes it, up to twice. Null sources are one source; wordless texts stand as
    often as their whole source is taken; equal rows are taken one by one; an empty table stays empty."""
    return C.few_parts(mixing.mixed(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its ids, checked by decoding. Null and empty texts have no ids; an empty table stays empty."""
    return C.few_parts(pieces.tokenize(docs, pieces.model_bytes(), keep=("doc_id", "lang", "source")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

#: The hashed n-gram model and the samplers have no SQL form; tests/llm/test_pipeline.py holds the run against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = C.materialise(docs)
    return docs
