"""The operators as stages of the corpus pipeline: ``(spark, docs, folder) -> docs``.

Each works on all rows that it is given. All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohort.llm import decontaminate, langid, line_dedup, ngram_join, packing

NEAR_SHINGLE = 5
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose text holds a letter stay, whatever their scores and also where no row has a label.

    The model learns from the labelled rows of this stage's own input.
    """
    return langid.keep_determined(docs, langid.fit(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines that many documents hold stay in one of them; every document stays."""
    return line_dedup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, as do rows without an id."""
    groups = ngram_join.near_groups(docs, NEAR_SHINGLE, NEAR_PERCENT)
    others = groups.filter("doc_id <> component_id").selectExpr("doc_id as _near_id").distinct()
    return docs.join(others, docs["doc_id"] == others["_near_id"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every piece of every document gets its place in a sequence."""
    return packing.pack(docs)
