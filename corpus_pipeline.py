"""From raw documents to packed training sequences.

Each stage takes the table that the one before it has kept and written; all but the last return the
columns of `documents`. The stages' functions are those of the operators.

Rows
    Every stage handles null and empty texts, repeated rows, empty tables and further columns as its
    operator's docstring says: empty texts are not toxic and hold no leak, and one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpus_search.llm.decontamination import clean
from corpus_search.llm.minhash import one_of_each
from corpus_search.llm.packing import pack
from corpus_search.llm.pii import redacted
from corpus_search.llm.tables import Stage, table
from corpus_search.llm.toxicity import harmless


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier chain calls toxic."""
    return harmless(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: SQL can express none of the stages; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    stage = Stage(spark)
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage.put(function(spark, docs, sf_dir), name)
    return docs
