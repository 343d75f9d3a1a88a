"""Written context in front of passages: prompts out, completions in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_search.functions.templates import fill
from corpus_search.functions.text import strip
from corpus_search.operators.chunking import truncate_documents
from corpus_search.settings import CONTEXT_TEMPLATE, IndexSettings

CHUNK_KEY = ["video_id", "chunk_index"]


def context_prompts(
    documents: DataFrame,
    chunks: DataFrame,
    settings: IndexSettings,
    template: str = CONTEXT_TEMPLATE,
) -> DataFrame:
    """One prompt per chunk. Prompts of one document are adjacent and in order, so a service that
    caches prompt prefixes reads the document once.

    The chunks of a document are listed in order (a document has at most 32,767, and together they
    are about as long as its text), joined to the text, and unfolded again. So the wide prompt rows
    are neither shuffled nor sorted.
    """
    texts = truncate_documents(documents, settings).select("video_id", "transcript")
    in_order = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk")))
    prompt = fill(template, transcript=F.col("transcript"), chunk=F.col("entry.chunk"))
    return (
        chunks.groupBy("video_id")
        .agg(in_order.alias("entries"))
        .join(texts, "video_id")
        .select("video_id", "transcript", F.explode("entries").alias("entry"))
        .select("video_id", F.col("entry.chunk_index"), prompt.alias("prompt"))
    )


def one_completion(completions: DataFrame, key: list[str]) -> DataFrame:
    """One completion per key, if it was delivered several times: a whole one before one that was
    cut off, one with text before one without, of equals the greatest text. The key is that of the
    join which follows, so nothing more is shuffled."""
    content = F.coalesce(F.col("content") != "", F.lit(False))
    whole = F.coalesce(F.col("finish_reason") != "length", F.lit(True))
    best = F.max(
        F.struct(content.alias("has_text"), whole.alias("is_whole"), "content", "finish_reason")
    )
    return (
        completions.groupBy(*key)
        .agg(best.alias("best"))
        .select(*key, "best.finish_reason", "best.content")
    )


def add_context(chunks: DataFrame, completions: DataFrame) -> DataFrame:
    """Put the completion in front of its chunk. A chunk whose completion is absent, cut off or
    empty stays bare; `is_fallback` tells which, `bare_chunk` keeps the words of the document. A
    completion that was delivered twice counts once."""
    content = F.col("content")
    fallback = F.coalesce(
        (F.col("finish_reason") == "length") | content.isNull() | (content == ""), content.isNull()
    )
    contextual = F.concat(F.lower(strip(content)), F.lit("\n"), F.col("chunk"))
    merged = chunks.join(one_completion(completions, CHUNK_KEY), CHUNK_KEY, "left")
    return merged.select(
        *CHUNK_KEY,
        F.when(fallback, F.col("chunk")).otherwise(contextual).alias("chunk"),
        F.col("chunk").alias("bare_chunk"),
        fallback.alias("is_fallback"),
    )


def fallback_rates(contextual: DataFrame) -> DataFrame:
    """Share of bare chunks per document, to stop a run whose context model keeps failing."""
    return contextual.groupBy("video_id").agg(
        F.count("*").alias("n_chunks"),
        F.sum(F.col("is_fallback").cast("int")).alias("n_fallbacks"),
        F.avg(F.col("is_fallback").cast("double")).alias("fallback_rate"),
    )


def check_fallbacks(contextual: DataFrame, highest_rate: float) -> None:
    rate = contextual.agg(F.avg(F.col("is_fallback").cast("double"))).first()[0]
    if rate is not None and rate > highest_rate:
        raise RuntimeError(f"{rate:.1%} of the chunks have no context, limit {highest_rate:.1%}")
