"""Membership and cosine of a bounded batch of queries in one scan, without moving candidate pairs.

The general way (`retrieval`) makes a row per query and matching chunk, shuffles it, and joins the
vectors. For a batch of queries that fits into memory, the chunks can stay where they are: every
task scores its chunks against the whole batch by matrix products, and hands on only rows that are
among its best so far. The results are the same.

The scan needs tokens, scores and vector of a chunk in one row. `search_rows` joins them once per
index version, so that no query batch has to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_search.functions.vectors import COSINE_SCALE
from corpus_search.operators.chunk_scoring import (
    CELLS,
    MAX_QUERIES,
    MAX_WORDS,
    QueryBatch,
    batch_of,
    by_chunk,
    matches,
)
from corpus_search.operators.retrieval import CHUNK_KEY, best_per_query

# Lexical scores are compared with nine decimals, so that ranks do not depend on the order of
# summation.
DECIMALS = 1e9

OUTPUT = (
    "query_id bigint, video_id string, chunk_index smallint, lexical_score double, cosine float"
)


def search_rows(knowledge: DataFrame, bm25: DataFrame) -> DataFrame:
    """video_id, chunk_index, tokens, scores, embedding. A chunk has at most as many tokens as the
    window size, so the collected lists are short."""
    return by_chunk(bm25).join(knowledge.select(*CHUNK_KEY, "embedding"), CHUNK_KEY)


def fits_batch(prepared: DataFrame) -> bool:
    """Whether the queries are few and short enough to be broadcast."""
    n_queries, n_words = prepared.agg(
        F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))
    ).first()
    return n_queries <= MAX_QUERIES and n_words <= MAX_WORDS


def query_batch(prepared: DataFrame, query_vectors: DataFrame) -> QueryBatch:
    """Only for queries that pass `fits_batch`, since they are collected and sent to all tasks."""
    if not fits_batch(prepared):
        raise ValueError("too many queries or words for one batch")
    rows = (
        prepared.join(query_vectors, "query_id")
        .select("query_id", F.array_distinct("words").alias("words"), "query_embedding")
        .collect()
    )
    return batch_of(*([row[i] for row in rows] for i in range(3)))


def score_rows(
    part: pa.RecordBatch,
    queries: QueryBatch,
    vocabulary: pa.Array,
    best: np.ndarray,
    positive: bool = True,
    by: str = "cosine",
) -> tuple[pa.RecordBatch, np.ndarray]:
    """Chunks against queries: the pairs with a common token whose cosine (or lexical score, for
    `by` "lexical_score") is among the best so far, and the best so far (a column per query, lowest
    first in no other order). Pairs equal to the lowest stay, so ties are settled later."""
    n_rows = part.num_rows
    lexical, matched = matches(part, queries, vocabulary)
    if "embedding" in part.schema.names:
        vectors = part.column("embedding").flatten().to_numpy().astype(np.float64)
        products = vectors.reshape(n_rows, -1) @ queries.vectors.T
    else:
        products = np.full(lexical.shape, np.nan)
    # Adding zero turns a negative zero into zero.
    cosine = (np.rint(products * COSINE_SCALE) / COSINE_SCALE + 0.0).astype(np.float32)
    if by == "cosine":
        fits = matched & np.isfinite(cosine)
        order = np.where(fits & (cosine > 0) if positive else fits, cosine, np.float32(-np.inf))
    else:
        lexical = np.rint(lexical * DECIMALS) / DECIMALS
        order = np.where(matched, lexical, -np.inf)
    best = np.partition(np.concatenate([best, order]), n_rows, axis=0)[n_rows:]
    at_row, at_query = np.nonzero(np.isfinite(order) & (order >= best[0]))
    kept = pa.RecordBatch.from_arrays(
        [
            pa.array(queries.ids[at_query]),
            part.column("video_id").take(pa.array(at_row)),
            part.column("chunk_index").take(pa.array(at_row)),
            pa.array(lexical[at_row, at_query]),
            pa.array(cosine[at_row, at_query]),
        ],
        names=["query_id", "video_id", "chunk_index", "lexical_score", "cosine"],
    )
    return kept, best


def score_batches(
    parts: Iterator[pa.RecordBatch],
    queries: QueryBatch | list[QueryBatch],
    cut: int,
    cells: int,
    positive: bool = True,
    by: str = "cosine",
) -> Iterator[pa.RecordBatch]:
    """All chunks of a task against the queries, or against one tile of queries after the other,
    `cells` pairs at a time."""
    tiles = queries if isinstance(queries, list) else [queries]
    vocabularies = [pa.array(tile.tokens, pa.string()) for tile in tiles]
    kind = np.float32 if by == "cosine" else np.float64
    best = [np.full((cut, len(tile.ids)), -np.inf, dtype=kind) for tile in tiles]
    for part in parts:
        for number, (tile, vocabulary) in enumerate(zip(tiles, vocabularies, strict=True)):
            step = max(1, cells // len(tile.ids))
            for at in range(0, part.num_rows, step):
                kept, best[number] = score_rows(
                    part.slice(at, step), tile, vocabulary, best[number], positive, by
                )
                yield kept


def best_in_place(
    rows: DataFrame,
    batch: QueryBatch | list[QueryBatch],
    cut: int,
    positive: bool = True,
    by: str = "cosine",
    rank: str = "dense_rank",
    cells: int | None = None,
) -> DataFrame:
    """The same rows as `retrieval.dense_candidates`: per query the `cut` most similar chunks among
    those that share a token with it and have a positive cosine (any, without `positive`). `by`
    "lexical_score" ranks by that, and needs no `embedding`. The batch may come in tiles."""
    tiles = [b for b in (batch if isinstance(batch, list) else [batch]) if len(b.ids)]
    if not tiles:
        return rows.sparkSession.createDataFrame([], f"{OUTPUT}, {rank} int")
    shared = rows.sparkSession.sparkContext.broadcast([vars(b) for b in tiles])
    cells = cells or CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return score_batches(
            batches, [QueryBatch(**b) for b in shared.value], cut, cells, positive, by
        )

    vectors = ["embedding"] if "embedding" in rows.columns else []
    scored = rows.select(*CHUNK_KEY, "tokens", "scores", *vectors).mapInArrow(run, OUTPUT)
    return best_per_query(scored, by, cut, rank)
