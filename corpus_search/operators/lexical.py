"""The lexical index: tokens, frequencies and BM25 scores of all chunks.

The index is computed in two passes over the chunks (frequencies, then scores), and neither pass
shuffles the token rows of frequent words:

* a chunk is one row, so its term frequencies are counted inside the row;
* document frequencies are summed in the tasks first and shuffle one row per token and task;
* scores need the token's IDF: a vocabulary of known, small size is broadcast; of a larger one only
  the frequent tokens are (a bounded number of them), and the rows of rare tokens are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.functions.arrays import word_counts
from corpus_search.functions.skew import HEAVY_KEYS, join_by_weight
from corpus_search.functions.stop_words import ENGLISH_STOP_WORDS
from corpus_search.functions.text import index_tokens, normalised_stop_words, raw_index_tokens
from corpus_search.settings import BM25_B, BM25_K1
from corpus_search.sources.staging import stage

# Two million rows of a token and two numbers take about 200 MB in an executor.
BROADCAST_TOKENS = 2_000_000


def stop_word_counts(
    chunks: DataFrame, stop_words: Sequence[str] = ENGLISH_STOP_WORDS
) -> DataFrame:
    """How often each stop word is dropped from the chunks."""
    return (
        chunks.select(F.explode(raw_index_tokens(F.col("chunk"))).alias("token"))
        .filter(F.col("token").isin(normalised_stop_words(stop_words)))
        .groupBy("token")
        .agg(F.count("*").alias("n_dropped"))
    )


def chunk_tokens(chunks: DataFrame, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """Tokens of every chunk and their number, which counts the one empty token of a blank chunk."""
    return chunks.select(
        "video_id", "chunk_index", index_tokens(F.col("chunk"), stop_words).alias("tokens")
    ).withColumn("n_tokens", F.size("tokens"))


def corpus_statistics(tokens: DataFrame) -> DataFrame:
    """One row: mean chunk length and number of chunks, blank chunks included."""
    return tokens.agg(
        F.avg("n_tokens").alias("avg_n_tokens"), F.count("*").alias("n_chunks")
    )


def term_frequencies(tokens: DataFrame, *others: str) -> DataFrame:
    """video_id, chunk_index, n_tokens, the `others`, token, tf.

    The outer explode keeps Catalyst from filtering on the size of the token array, which would
    compute the tokens a second time.
    """
    return (
        tokens.select(
            "video_id",
            "chunk_index",
            "n_tokens",
            *others,
            F.explode_outer(word_counts(F.col("tokens"))).alias("term"),
        )
        .select(
            "video_id",
            "chunk_index",
            "n_tokens",
            *others,
            F.col("term.value").alias("token"),
            F.col("term.count").alias("tf"),
        )
        .filter(F.col("token") != "")
    )


def document_frequencies(terms: DataFrame) -> DataFrame:
    return terms.groupBy("token").agg(F.count("*").alias("df"))


def inverse_document_frequencies(frequencies: DataFrame, n_chunks: Column) -> DataFrame:
    df = F.col("df")
    return frequencies.select(
        "token", "df", F.log((n_chunks - df + 0.5) / (df + 0.5) + 1).alias("idf")
    )


def saturation(tf: Column, length: Column, k1: float, b: float) -> Column:
    """The part of a score that a chunk decides; `length` is relative to the mean. It grows with
    `tf` and falls with `length`."""
    return (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length))


def bm25_scores(
    chunks: DataFrame,
    k1: float = BM25_K1,
    b: float = BM25_B,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    heavy_keys: int = HEAVY_KEYS,
    frequencies: DataFrame | None = None,
    tokens: DataFrame | None = None,
) -> DataFrame:
    """video_id, chunk_index, token, score for every token of every chunk. `tokens` are the stored
    `chunk_tokens`, if there are any.

    `frequencies` is the stored result of `document_frequencies`, if there is one. Its rows are
    counted, and the whole vocabulary is broadcast when it has at most BROADCAST_TOKENS.
    """
    if tokens is None:
        tokens = chunk_tokens(chunks, stop_words)
    terms = term_frequencies(tokens)
    # One row, so it is a scalar subquery and needs no join.
    statistics = (
        corpus_statistics(tokens).select(F.struct("avg_n_tokens", "n_chunks")).scalar()
    )
    is_small = frequencies is not None and frequencies.count() <= BROADCAST_TOKENS
    if frequencies is None:
        frequencies = document_frequencies(terms)
    idf = inverse_document_frequencies(frequencies, statistics["n_chunks"])
    if is_small:
        weighted = terms.join(F.broadcast(idf), "token")
    else:
        weighted = join_by_weight(terms, idf, "token", "df", heavy_keys)
    length = F.col("n_tokens") / statistics["avg_n_tokens"]
    score = F.col("idf") * saturation(F.col("tf"), length, k1, b)
    return weighted.select("video_id", "chunk_index", "token", score.alias("score"))


def build_bm25(
    chunks: DataFrame,
    folder: str,
    k1: float = BM25_K1,
    b: float = BM25_B,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """`bm25_scores` with the tokens and the document frequencies stored in `folder` on the way, so
    that they are computed once and their number is known."""
    tokens = stage(chunk_tokens(chunks, stop_words), f"{folder}/tokens")
    frequencies = stage(document_frequencies(term_frequencies(tokens)), f"{folder}/frequencies")
    return bm25_scores(chunks, k1, b, stop_words, frequencies=frequencies, tokens=tokens)
