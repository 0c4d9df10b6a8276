"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import bpe, conversations, ctw, html_extract, langid, mixing, near_dedup, oracles, pieces, secret_scan, url_filter, variants
from .merkle import merkle_neighbours
from .quality import quality


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(C.table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(C.table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = C.table(spark, sf_dir, "labels")
    return quality(C.table(spark, sf_dir, "documents"), labels.where("quality = 1"), labels.where("quality = 0"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(C.table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").withColumn("held_out", C.hash_bucket("doc_id", 4) == 2)
    model = langid.train(docs.where("not held_out"))
    return langid.identify(docs, model, keep=("doc_id", "held_out"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(C.table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokenize(C.table(spark, sf_dir, "documents"), pieces.model_bytes())


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").withColumn("held_out", C.hash_bucket("doc_id", 10) == 0)
    return ctw.score(docs, "held_out", keep=("doc_id", "held_out"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_neighbours(C.table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(C.table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(C.table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damaged(C.table(spark, sf_dir, "conversations")))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(C.table(spark, sf_dir, "documents"), bpe.model_bytes(), ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_secret_scans": op2_secret_scans,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filters": op4_url_filters,
    "op5_language_id": op5_language_id,
    "op6_mixing": op6_mixing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_html_extraction": op10_html_extraction,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_bpe": op13_bpe,
}

#: Queries that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op2_secret_scans": oracles.secrets(secret_scan.EXAMPLE_REPOSITORIES, secret_scan.EXAMPLE_OWNERS),
    "op11_spelling_variants": oracles.VARIANTS,
    "op12_conversation_repair": oracles.CONVERSATIONS,
}
