"""A corpus pipeline: quality, near duplicates, benchmark leaks, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and all that the one before kept; all but the last return
the columns of documents. The last one returns the mixture itself, a row for each epoch that takes a
document; the query sums it up to the words taken of each document.

In every stage a null text counts as an empty one, texts of any length are read whole, repeated rows and rows of one doc_id are rows of their
own, an empty table gives no rows, and further columns pass through, but for epoch and taken, which the mixture names itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuesheaf.llm import common, decontaminate, mixing, prefix_join, secret_ledger, subword_classifier


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword classifier, trained on the labels, accepts; one of score exactly at the limit stays, null and empty texts have a score as others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "quality AS label")
    return subword_classifier.accepted(docs, subword_classifier.trained(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join of 5-grams at 80 %; the op8 query keeps its 3-grams at 90 %.

    Of equal texts and of a component the smallest doc_id stays (of its rows one a text), null ids last; texts without a word are linked with nothing and stay.
    """
    return prefix_join.one_of_each(docs, k=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item; null and empty texts cover none, and an item without words is covered by none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; overlapping spans become one mark, a null text stays null."""
    return secret_ledger.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mixture, with epoch and taken; documents without a word give none, ties of doc_id go by size."""
    return mixing.mixture(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("secrets", secrets), ("mixture", mixture)]
#: A trained classifier has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of each document that the stages before it keep."""
    kept = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        kept, docs = docs, common.stored(stage(spark, docs, sf_dir))
    return mixing.digest(kept, docs)
