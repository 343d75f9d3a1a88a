"""The knowledge base: chunks with title and position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.functions.skew import join_by_weight

# Titles can be long, so fewer heavy documents than heavy tokens are broadcast.
HEAVY_DOCUMENTS = 1_000


def rounded(fraction: Column) -> Column:
    """Two decimals, halves to even, in floating point. Spark's own `round` goes through decimals
    and gives other results, for example for 23/40."""
    return F.rint(fraction * 100) / 100


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks per document. Summed in the tasks first, so a document of any size is no hot spot."""
    return chunks.groupBy("video_id").agg(
        F.max("chunk_index").alias("chunk_count"), F.count("*").alias("n_rows")
    )


def knowledge_base(
    chunks: DataFrame, transcripts: DataFrame, heavy_keys: int = HEAVY_DOCUMENTS
) -> DataFrame:
    """video_id, chunk_index, title, start, end, chunk, embedding. Chunks of unknown documents
    vanish; marks are fractions of the document."""
    titles = chunk_counts(chunks).join(transcripts.select("video_id", "title"), "video_id")
    index, count = F.col("chunk_index"), F.col("chunk_count")
    return join_by_weight(chunks, titles, "video_id", "n_rows", heavy_keys).select(
        "video_id",
        "chunk_index",
        "title",
        rounded((index - 1) / count).alias("start"),
        rounded(index / count).alias("end"),
        "chunk",
        "embedding",
    )


def co_bucketed_knowledge(chunks: DataFrame, transcripts: DataFrame) -> DataFrame:
    """`knowledge_base` for tables that share their buckets (`sources.buckets`): counting and both
    joins go bucket by bucket, without an exchange. Wide rows stay where they are, so heavy documents
    need no way of their own."""
    titles = chunk_counts(chunks).join(transcripts.select("video_id", "title").hint("merge"), "video_id")
    index, count = F.col("chunk_index"), F.col("chunk_count")
    return chunks.join(titles.hint("merge"), "video_id").select(
        "video_id",
        "chunk_index",
        "title",
        rounded((index - 1) / count).alias("start"),
        rounded(index / count).alias("end"),
        "chunk",
        "embedding",
    )


def ordered(knowledge: DataFrame) -> DataFrame:
    return knowledge.sort("video_id", "start", "chunk_index")
