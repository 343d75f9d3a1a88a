"""The whole funnel: from prepared queries to ranked results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_search.operators.batch_scoring import (
    best_in_place,
    fits_batch,
    query_batch,
    search_rows,
)
from corpus_search.operators.chunk_scoring import token_batch
from corpus_search.operators.embedding import Embedder, embed_queries
from corpus_search.operators.knowledge import knowledge_base
from corpus_search.operators.reranking import Reranker
from corpus_search.operators.retrieval import (
    dense_candidates,
    lexical_candidates,
    query_tokens,
    result_columns,
    top_results,
    with_cosine,
    with_relevance,
)
from corpus_search.operators.tiled_scoring import TILE_QUERIES, best_by_tiles, query_tiles
from corpus_search.settings import SearchSettings
from corpus_search.sources.staging import stage


@dataclass(frozen=True)
class SearchIndex:
    """What searches read. Knowledge base and rows are made once per version of the stored tables."""

    bm25: DataFrame
    knowledge: DataFrame
    rows: DataFrame


def open_index(
    transcripts: DataFrame, chunks: DataFrame, bm25: DataFrame, folder: str
) -> SearchIndex:
    knowledge = open_knowledge(transcripts, chunks, folder)
    return SearchIndex(bm25, knowledge, open_rows(knowledge, bm25, folder))


def open_knowledge(transcripts: DataFrame, chunks: DataFrame, folder: str) -> DataFrame:
    return stage(knowledge_base(chunks, transcripts), f"{folder}/knowledge")


def open_rows(knowledge: DataFrame, bm25: DataFrame, folder: str) -> DataFrame:
    return stage(search_rows(knowledge, bm25), f"{folder}/rows")


def joined_candidates(
    prepared: DataFrame,
    knowledge: DataFrame,
    bm25: DataFrame,
    settings: SearchSettings,
    embedder: Embedder,
    is_small: bool = False,
) -> DataFrame:
    """The first half of the funnel as joins: chunks meet the queries' tokens, then their vectors. A
    batch of queries is cut where the chunks are scored; for more there is a row for every query and
    chunk with a common token."""
    tokens, vectors = query_tokens(prepared), embed_queries(prepared, embedder)
    if (batch := token_batch(tokens, vectors)) is not None:
        asked = bm25.join(F.broadcast(tokens.select("token").distinct()), "token", "left_semi")
        return best_in_place(search_rows(knowledge, asked), batch, settings.dense_cut)
    lexical = lexical_candidates(bm25, tokens, is_small)
    similar = with_cosine(lexical, knowledge, vectors)
    return dense_candidates(similar, settings.dense_cut)


def tiled_candidates(
    prepared: DataFrame,
    rows: DataFrame,
    settings: SearchSettings,
    embedder: Embedder,
    tile_queries: int = TILE_QUERIES,
) -> DataFrame:
    """The first half of the funnel as block products, for any number of queries."""
    tiles, n_tiles = query_tiles(prepared, embed_queries(prepared, embedder), tile_queries)
    return best_by_tiles(rows, tiles, n_tiles, settings.dense_cut)


def scored_candidates(
    prepared: DataFrame,
    knowledge: DataFrame,
    bm25: DataFrame,
    settings: SearchSettings,
    embedder: Embedder,
    reranker: Reranker,
    rows: DataFrame | None = None,
) -> DataFrame:
    """Everything up to the relevance score.

    With `rows` (from `search_rows`) the chunks are scored where they are if the queries are few
    enough to be sent to them, and in tiles otherwise; without, candidates are found by joins. The
    number of queries also bounds the rows that are left after the cosine cut.
    """
    is_small = fits_batch(prepared)
    if rows is not None and is_small:
        batch = query_batch(prepared, embed_queries(prepared, embedder))
        dense = best_in_place(rows, batch, settings.dense_cut)
        n_queries = len(batch.ids)
    else:
        dense = (
            joined_candidates(prepared, knowledge, bm25, settings, embedder, is_small)
            if rows is None
            else tiled_candidates(prepared, rows, settings, embedder)
        )
        n_queries = prepared.count()
    return with_relevance(
        dense, knowledge, prepared, reranker, settings.dense_cut * n_queries
    )


def search(
    prepared: DataFrame,
    knowledge: DataFrame,
    bm25: DataFrame,
    settings: SearchSettings,
    embedder: Embedder,
    reranker: Reranker,
    rows: DataFrame | None = None,
) -> DataFrame:
    """query_id, rank, title, url, start, end, excerpt: the k best passages of every query."""
    scored = scored_candidates(prepared, knowledge, bm25, settings, embedder, reranker, rows)
    return result_columns(top_results(scored, settings), settings.url_prefix)
