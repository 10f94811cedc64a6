"""A cleaning pipeline over `documents`: quality, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next one's docs. All but the last return the columns of documents; their decisions are rows left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontaminate, ngram_join, quality_net, secret_ledger, vector_packing
from barloom.llm.shared import cut_lineage, forget, small_batches, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality network scores 0.7 or more."""
    return quality_net.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class linked by shingle Jaccard similarity of 0.75 or more."""
    return ngram_join.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no item of the benchmark occurs within its error budget."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a secret."""
    return secret_ledger.without_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in packed sequences."""
    return vector_packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secrets", secrets),
    ("packing", packing),
]

#: No stage but the fourth can be expressed in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each one's table goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    with small_batches(spark):
        for _, stage in STAGES:
            docs = cut_lineage(stage(spark, docs, sf_dir))
            forget(before)
            before = docs
    return docs
