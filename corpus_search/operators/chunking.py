"""Overlapping passages of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.functions.text import document_words
from corpus_search.settings import IndexSettings


def truncated_words(text: Column, settings: IndexSettings) -> Column:
    """The document's tokens up to the limit of the context window."""
    return F.slice(document_words(text), 1, settings.max_document_tokens)


def truncate_documents(documents: DataFrame, settings: IndexSettings) -> DataFrame:
    return documents.withColumn(
        "transcript", F.array_join(truncated_words(F.col("transcript"), settings), " ")
    )


def split_documents(documents: DataFrame, settings: IndexSettings) -> DataFrame:
    """Windows of `chunk_size` words that share `overlap` words with the one before, numbered from
    1. A document without words gives no row. Documents are indexed whole; a limit is only set for
    the window of a prompt (`truncate_documents`).

    Narrow: every document is cut where it was read.
    """
    size, stride = settings.chunk_size, settings.stride
    words = documents.select("video_id", document_words(F.col("transcript")).alias("words"))
    last = F.greatest(
        F.lit(0), F.ceil((F.size("words") - size) / F.lit(stride)).cast("int")
    )
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda window: F.array_join(F.slice("words", window * stride + 1, size), " "),
    )
    return words.select(
        "video_id",
        F.posexplode(F.when(F.size("words") > 0, windows)).alias("position", "chunk"),
    ).select(
        "video_id", (F.col("position") + 1).cast("short").alias("chunk_index"), "chunk"
    )


def documents_without_chunks(documents: DataFrame) -> DataFrame:
    """Ids of the documents that `split_documents` leaves out."""
    blank = F.size(document_words(F.coalesce(F.col("transcript"), F.lit("")))) == 0
    return documents.filter(blank).select("video_id")
