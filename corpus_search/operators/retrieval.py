"""The retrieval funnel for a whole table of queries.

lexical membership -> cosine top 250 -> titled passage -> relevance threshold -> top k

Wide columns travel late. The first half moves only ids, vectors and scores; titles and texts are
joined to the at most 250 rows per query that are left. Ties are always broken by the chunk's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_search.functions.skew import broadcast_if_bounded, join_salted
from corpus_search.functions.vectors import cosine_similarity
from corpus_search.operators.chunk_scoring import listed, matched_chunks, token_batch
from corpus_search.operators.reranking import Reranker
from corpus_search.settings import SearchSettings

CHUNK_KEY = ["video_id", "chunk_index"]
PAIR_KEY = ["query_id", *CHUNK_KEY]

# Rows of three ids and a score; 500,000 of them take about 50 MB in memory.
BROADCAST_ROWS = 500_000


def query_tokens(prepared: DataFrame) -> DataFrame:
    """query_id, token; a repeated word counts once."""
    return prepared.select("query_id", F.explode(F.array_distinct("words")).alias("token"))


def lexical_candidates(bm25: DataFrame, tokens: DataFrame, is_small: bool = False) -> DataFrame:
    """query_id, video_id, chunk_index, lexical_score of every chunk that shares a token with the
    query. Nothing is cut here.

    A batch of queries is broadcast (`token_batch`): the index gives a row per chunk with the asked
    tokens, and the pairs are listed from it, so that no pair is shuffled. A larger query table is
    joined by a shuffle on the token, with the rows of frequent tokens dealt out over many tasks;
    scores are summed in the tasks before they are shuffled.
    """
    if (batch := token_batch(tokens)) is not None:
        return listed(matched_chunks(bm25, tokens), batch)
    if is_small:
        matches = bm25.join(F.broadcast(tokens), "token")
    else:
        matches = join_salted(bm25, tokens, "token", CHUNK_KEY)
    return matches.groupBy(*PAIR_KEY).agg(F.sum("score").alias("lexical_score"))


def passages(candidates: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Candidates with their knowledge-base columns; unknown chunks vanish."""
    return candidates.join(knowledge, CHUNK_KEY)


def with_cosine(
    candidates: DataFrame, knowledge: DataFrame, query_vectors: DataFrame
) -> DataFrame:
    vectors = knowledge.select(*CHUNK_KEY, "embedding")
    return (
        candidates.join(vectors, CHUNK_KEY)
        .join(query_vectors, "query_id")
        .select(
            *PAIR_KEY,
            "lexical_score",
            cosine_similarity(F.col("embedding"), F.col("query_embedding")).alias("cosine"),
        )
    )


def lexical_passages(bm25: DataFrame, tokens: DataFrame, knowledge: DataFrame, *columns: str) -> DataFrame:
    """`passages` of `lexical_candidates`, with the given columns of the knowledge base. A batch of
    queries is scored once the chunk's row has them, so that they travel once per chunk."""
    if (batch := token_batch(tokens)) is None:
        return passages(lexical_candidates(bm25, tokens), knowledge).select(
            *PAIR_KEY, "lexical_score", *columns
        )
    chunks = passages(matched_chunks(bm25, tokens), knowledge.select(*CHUNK_KEY, *columns))
    return listed(chunks, batch, *columns)


def lexical_similarities(
    bm25: DataFrame, tokens: DataFrame, knowledge: DataFrame, query_vectors: DataFrame
) -> DataFrame:
    """`with_cosine` of `lexical_candidates`. For a batch of queries the vectors are joined to the
    chunk's row, and its pairs are listed with both scores."""
    if (batch := token_batch(tokens, query_vectors)) is None:
        return with_cosine(lexical_candidates(bm25, tokens), knowledge, query_vectors)
    chunks = passages(matched_chunks(bm25, tokens), knowledge.select(*CHUNK_KEY, "embedding"))
    return listed(chunks, batch, cosine=True)


def best_per_query(rows: DataFrame, score: str, limit: int, rank: str = "rank") -> DataFrame:
    """The `limit` best rows of every query. Each task keeps at most `limit` rows per query before
    the shuffle, so a query that matches everything is no hot spot."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), *CHUNK_KEY)
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= limit)


def dense_candidates(similarities: DataFrame, cut: int) -> DataFrame:
    """The `cut` most similar chunks per query, among those with a positive cosine.

    Filtering after the cut gives the same rows as before it, and it keeps Catalyst from computing
    every cosine twice, once for the filter and once for the column.
    """
    return best_per_query(similarities, "cosine", cut, "dense_rank").filter(F.col("cosine") > 0)


def titled_passage(title: Column, chunk: Column) -> Column:
    return F.concat(F.lower(title), F.lit(": "), chunk)


def with_relevance(
    candidates: DataFrame,
    knowledge: DataFrame,
    prepared: DataFrame,
    reranker: Reranker,
    row_bound: int,
) -> DataFrame:
    """Attach title, marks and text to the candidates that are left, and score them."""
    texts = knowledge.select(*CHUNK_KEY, "title", "start", "end", "chunk")
    attached = texts.join(
        broadcast_if_bounded(candidates, row_bound, BROADCAST_ROWS), CHUNK_KEY
    )
    return attached.join(prepared.select("query_id", "corrected"), "query_id").select(
        *PAIR_KEY,
        "lexical_score",
        "cosine",
        "dense_rank",
        "title",
        "start",
        "end",
        "chunk",
        reranker(F.col("corrected"), titled_passage(F.col("title"), F.col("chunk"))).alias(
            "relevance"
        ),
    )


def above_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    """Relevance is single precision, so the limit is too: 0.9 as a double is larger than 0.9 as a
    float and would drop rows exactly at the limit."""
    return scored.filter(F.col("relevance") >= F.lit(threshold).cast("float"))


def result_columns(ranked: DataFrame, url_prefix: str) -> DataFrame:
    return ranked.select(
        "query_id",
        "rank",
        "title",
        F.concat(F.lit(url_prefix), F.col("video_id")).alias("url"),
        "start",
        "end",
        F.col("chunk").alias("excerpt"),
    )


def top_results(scored: DataFrame, settings: SearchSettings) -> DataFrame:
    relevant = above_threshold(scored, settings.threshold)
    return best_per_query(relevant, "relevance", settings.k)
