"""Embedding columns.

An embedder is a function from a text column to an array<float> column of unit length. The default
hashes words and needs no model; it has the shape of a trained embedder, not its quality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.functions.text import index_tokens
from corpus_search.functions.vectors import hashed_bag_of_words, l2_normalise, require_width
from corpus_search.settings import (
    DOCUMENT_PREFIX,
    EMBEDDING_WIDTH,
    MODEL_BATCH,
    QUERY_PREFIX,
)

Embedder = Callable[[Column], Column]
TextModel = Callable[[list[str]], np.ndarray]


def with_document_prefix(text: Column) -> Column:
    return F.concat(F.lit(DOCUMENT_PREFIX), text)


def with_query_prefix(text: Column) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), text)


def hashed_embedder(width: int = EMBEDDING_WIDTH) -> Embedder:
    """Signed hashing of the text's index tokens. The task prefix is an instruction to trained
    models, so it does not count as words here."""

    def embed(text: Column) -> Column:
        bare = text
        for prefix in (DOCUMENT_PREFIX, QUERY_PREFIX):
            bare = F.when(
                F.startswith(bare, F.lit(prefix)), F.substring(bare, len(prefix) + 1, 2**31 - 1)
            ).otherwise(bare)
        words = F.filter(index_tokens(bare), lambda token: token != "")
        return hashed_bag_of_words(words, width)

    return embed


def model_embedder(load: Callable[[], TextModel], batch_size: int = MODEL_BATCH) -> Embedder:
    """Embedder around a trained model. `load` runs once per task; the model sees batches of texts
    and returns a matrix with one row per text."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            rows = [
                np.asarray(model(texts.iloc[at : at + batch_size].tolist()), dtype=np.float32)
                for at in range(0, len(texts), batch_size)
            ]
            yield pd.Series(list(np.concatenate(rows)) if rows else [], dtype=object)

    return lambda text: l2_normalise(run(text))


def embed_chunks(chunks: DataFrame, embedder: Embedder, width: int) -> DataFrame:
    """The stored chunk table: video_id, chunk_index, chunk, embedding."""
    return chunks.select(
        "video_id",
        "chunk_index",
        "chunk",
        embedder(with_document_prefix(F.col("chunk"))).alias("embedding"),
    ).withColumn("embedding", require_width(F.col("embedding"), width))


def embed_queries(queries: DataFrame, embedder: Embedder) -> DataFrame:
    return queries.select(
        "query_id", embedder(with_query_prefix(F.col("corrected"))).alias("query_embedding")
    )
