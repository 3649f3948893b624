"""The queries of the training-data operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontaminate, line_dedup, line_frequency, lm_scoring, mixing, paragraph_dedup, prefix_join, secret_ledger, string_kernel, subword_classifier, token_alignment, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _read(spark, sf_dir, "labels").filter("quality = 1")
    return lm_scoring.cross_entropy_difference(_read(spark, sf_dir, "documents"), target)


def op2_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.line_frequency(_read(spark, sf_dir, "documents"))


def op4_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeats(_read(spark, sf_dir, "documents"))


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return secret_ledger.digest(secret_ledger.scan_batches(docs)[0])


def op6_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_kernel.identify(_read(spark, sf_dir, "documents"))


def op7_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.join_components(_read(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("source")


def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_classifier.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(_read(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return line_dedup.digest(line_dedup.deduplicated(docs, line_dedup.in_batches(docs)))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(_read(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_cross_entropy, op2_string_tiling, op3_line_frequency, op4_paragraph_minhash, op5_secret_ledger, op6_string_kernel, op7_bigru_toxicity, op8_prefix_join, op9_source_mixing, op10_subword_quality, op11_token_alignment, op12_line_dedup, op13_conversation_repair)}
ORACLES = {"op1_cross_entropy": lm_scoring.SQL, "op3_line_frequency": line_frequency.SQL, "op4_paragraph_minhash": paragraph_dedup.SQL, "op8_prefix_join": prefix_join.SQL, "op9_source_mixing": mixing.SQL, "op12_line_dedup": line_dedup.SQL}
