"""Relevance of a passage to a query.

A reranker is a function from (query column, passage column) to a probability. The default measures
word overlap and needs no model; it has the shape of a trained cross-encoder, not its quality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_search.functions.text import query_words
from corpus_search.settings import MODEL_BATCH

Reranker = Callable[[Column, Column], Column]
PairModel = Callable[[list[tuple[str, str]]], np.ndarray]

# Weights of the default reranker's features, and its bias.
COVERAGE_WEIGHT = 10.0
PHRASE_WEIGHT = 2.0
BIAS = -5.0


def overlap_reranker(max_words: int | None = None) -> Reranker:
    """Sigmoid of the share of distinct query words the passage holds, with a bonus for a passage
    that holds the whole query as a phrase. With `max_words`, words after that do not count, as in a
    cross-encoder with a fixed input length."""

    def score(query: Column, passage: Column) -> Column:
        wanted = F.array_distinct(query_words(query))
        seen = query_words(passage)
        if max_words is not None:
            seen = F.slice(seen, 1, max_words)
        coverage = F.size(F.array_intersect(wanted, seen)) / F.greatest(F.size(wanted), F.lit(1))
        phrase = F.contains(
            F.concat(F.lit(" "), F.array_join(seen, " "), F.lit(" ")),
            F.concat(F.lit(" "), F.array_join(query_words(query), " "), F.lit(" ")),
        )
        logit = coverage * COVERAGE_WEIGHT + phrase.cast("double") * PHRASE_WEIGHT + BIAS
        return (1 / (1 + F.exp(-logit))).cast("float")

    return score


def model_reranker(load: Callable[[], PairModel], batch_size: int = MODEL_BATCH) -> Reranker:
    """Reranker around a trained model. `load` runs once per task; the model sees batches of
    (query, passage) pairs and returns one probability per pair."""

    @F.pandas_udf("float")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, passages in batches:
            pairs = list(zip(queries.tolist(), passages.tolist(), strict=True))
            scores = [
                np.asarray(model(pairs[at : at + batch_size]), dtype=np.float32)
                for at in range(0, len(pairs), batch_size)
            ]
            yield pd.Series(np.concatenate(scores) if scores else [], dtype="float32")

    return lambda query, passage: run(query, passage)
