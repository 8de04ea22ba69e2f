"""Corpus pipeline: quality, exact copies, near copies, benchmark leaks, mix of sources - in this order.

Each stage takes the rows that the stage before kept, written as Parquet and read again. All but the
last return the columns of documents; the last adds the weight and the chance of the drawn rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, exact_dedup, mixing, ngram_join, quality
from barloom.llm.base import stage, table
from barloom.llm.catalog import MIX_POWERS


def all_columns(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that `operator` returns, with the columns of docs: those that it does not read travel aside under one name."""
    read = ["doc_id", "text", "lang", "source"]
    rest = [c for c in docs.columns if c not in read]
    packed = docs.select(*read, F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("pipeline_rest"))
    return operator(packed).select(*[F.col(c) if c in read else F.col("pipeline_rest")[c].alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (operator 6)."""
    return all_columns(docs, lambda d: quality.graded(d, table(spark, sf_dir, "labels")).where("qc_kept"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (operator 7)."""
    return all_columns(docs, lambda d: exact_dedup.grouped_copies(d).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies: five words, similarity 0.8 (operator 3)."""
    groups = ngram_join.similar_groups(docs, n=5, num=80, den=100)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark (operator 2)."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of source, language and topic (operator 1)."""
    own = [c for c in docs.columns if c not in ("topic", "tokens", "probability")]  # the results replace them
    return mixing.mixed(docs, MIX_POWERS, strict=False).where("mx_kept").select(*own, F.col("mx_topic").alias("topic"), F.col("mx_tokens").alias("tokens"), F.col("mx_probability").alias("probability"))


STAGES = [("quality classifier", keep_good), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_leaks), ("mixing sources to target weights", mix_sources)]
ORACLE_SQL = None  # the classifier is trained and near copies are groups of links: tests/llm compares every stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
