"""Consistency of the stored tables with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_search.functions.text import document_words, index_tokens

KEY = ["video_id", "chunk_index"]


def index_issues(transcripts: DataFrame, chunks: DataFrame, bm25: DataFrame) -> DataFrame:
    """issue, video_id, chunk_index for everything that is in one table and missing in another.

    A blank document has no chunks and a chunk of stop words has no scores; neither is an issue.
    """
    no_index = F.lit(None).cast("smallint").alias("chunk_index")
    orphans = (
        chunks.select("video_id")
        .distinct()
        .join(transcripts.select("video_id"), "video_id", "left_anti")
        .select(F.lit("chunk_without_transcript").alias("issue"), "video_id", no_index)
    )
    unindexed = (
        transcripts.filter(F.size(document_words(F.col("transcript"))) > 0)
        .select("video_id")
        .join(chunks.select("video_id").distinct(), "video_id", "left_anti")
        .select(F.lit("transcript_without_chunk").alias("issue"), "video_id", no_index)
    )
    has_tokens = F.exists(index_tokens(F.col("chunk")), lambda token: token != "")
    unscored = (
        chunks.filter(has_tokens)
        .select(*KEY)
        .join(bm25.select(*KEY).distinct(), KEY, "left_anti")
        .select(F.lit("chunk_without_score").alias("issue"), *KEY)
    )
    return orphans.unionByName(unindexed).unionByName(unscored)
