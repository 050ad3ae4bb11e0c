"""Documents to packed training batches, in stages.

Every stage takes what the one before kept and is written as Parquet in between.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseframe.llm.common import table, written
from pulseframe.llm.mil import good_documents, train
from pulseframe.llm.nearcopies import one_of_near_copies
from pulseframe.llm.packing import packed, word_lengths
from pulseframe.llm.secrets import redacted
from pulseframe.llm.substrings import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    return good_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are alike by 0.8 or more."""
    return one_of_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand elsewhere too."""
    return without_repeats(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced."""
    return redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in token-budget batches of optimal length buckets."""
    return packed(word_lengths(docs))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_redaction),
    ("packing", pack),
]

#: The classifier and the fingerprints cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
