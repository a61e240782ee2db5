"""The corpus pipeline: stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohort.llm import stages
from cohort.operators.staging import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_dedup_stage),
    ("near_duplicates", stages.near_duplicates),
    ("decontamination", stages.decontamination),
    ("packing", stages.pack),
]

# String kernels and tokens have no SQL form; the tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stage(docs)
    return docs
