"""From raw documents to a mix for training: five stages, each a DataFrame in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepath.llm.common import read_table, remainder, stored
from tidepath.llm.contamination import remove_contaminated
from tidepath.llm.lines import dedup_lines
from tidepath.llm.mixing import mixed_documents
from tidepath.llm.ordered_minhash import keep_one_per_group
from tidepath.llm.toxicity import remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score is 0.3 or more."""
    labels = read_table(spark, sf_dir, "labels")
    return remove_toxic(docs, labels, learn=remainder("doc_id", 4) != 2)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines, of any length, that an earlier document has, or nearly has; documents stay."""
    return dedup_lines(docs, shortest=1).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return keep_one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    return remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that the sources have their target weights."""
    return mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# SQL cannot express a stage that learns from labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is stored before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
