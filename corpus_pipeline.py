"""The corpus pipeline: quality, near duplicates, benchmark passages, packing.

Each stage gets what its predecessor kept, all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkveil.llm import decontamination, packing, quality, similar
from sparkveil.llm.common import remove, shared_dir, table


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject; it learns from the labelled documents of sf_dir."""
    return quality.reject(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates: 5-word shingle sets with a similarity of 0.8 or more.

    Candidates are op1's links of SimHash fingerprints and, as these can't be all (see the README), MinHash's; the sets decide.
    """
    return similar.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_text),
    ("near_duplicates", one_of_each),
    ("decontamination", no_benchmark),
    ("packing", packed),
]

#: No SQL can compress with a dictionary or tokenise; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written as Parquet into the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # nothing reads it any more
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
