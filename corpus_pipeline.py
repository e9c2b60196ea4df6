"""Corpus pipeline: STAGES are applied to `documents` in order, each stage written and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulark.llm.common import Scratch, table
from tabulark.llm.factorisation import keep_good
from tabulark.llm.line_dedup import without_repeated_lines
from tabulark.llm.mixing import mixed
from tabulark.llm.near_dedup import drop_near_duplicates
from tabulark.llm.packing import pack_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that five documents or more repeat, except in the largest doc_id."""
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays (five words, similarity 0.8)."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scarce domains are repeated until the expected totals match; no document is dropped (lower=1)."""
    return mixed(docs, table(spark, sf_dir, "labels"), temperature=0.9, lower=1.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Two stages depend on fitted models, which SQL cannot express; tests/llm compare the rest with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
