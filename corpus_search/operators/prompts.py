"""Prompts from search results, and answers from completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.functions.templates import fill
from corpus_search.operators.context import one_completion
from corpus_search.settings import (
    DELIMITER,
    EMPTY_ANSWER,
    SYSTEM_TEMPLATE,
    USER_TEMPLATE,
    VIDEO_SEARCH_URL,
)


def entry_text() -> Column:
    """One search result as five labelled lines."""
    lines = [
        ("TITLE: ", F.col("title")),
        ("\nURL: ", F.col("url")),
        ("\nSTART: ", F.col("start").cast("string")),
        ("\nEND: ", F.col("end").cast("string")),
        ("\nEXCERPT: ", F.col("excerpt")),
    ]
    return F.concat(*[part for label, value in lines for part in (F.lit(label), value)])


def context_blocks(results: DataFrame, delimiter: str = DELIMITER) -> DataFrame:
    """query_id, context: the entries in rank order. A query has at most k of them."""
    entries = F.array_sort(F.collect_list(F.struct("rank", entry_text().alias("entry"))))
    return results.groupBy("query_id").agg(
        F.array_join(
            F.transform(entries, lambda entry: entry["entry"]), f"\n{delimiter}\n"
        ).alias("context")
    )


def user_prompts(
    queries: DataFrame,
    results: DataFrame,
    template: str = USER_TEMPLATE,
    delimiter: str = DELIMITER,
) -> DataFrame:
    """query_id, prompt. The prompt holds the query as it was asked; a query without results gets
    an empty context."""
    context = F.coalesce("context", F.lit(""))
    return queries.join(context_blocks(results, delimiter), "query_id", "left").select(
        "query_id", fill(template, context=context, query=F.col("query")).alias("prompt")
    )


def system_prompts(
    queries: DataFrame,
    template: str = SYSTEM_TEMPLATE,
    delimiter: str = DELIMITER,
    search_url: str = VIDEO_SEARCH_URL,
) -> DataFrame:
    return queries.select(
        "query_id",
        fill(
            template,
            delimiter=F.lit(delimiter),
            youtube_search_url=F.lit(search_url),
            query=F.col("query"),
        ).alias("prompt"),
    )


def answers(
    queries: DataFrame, completions: DataFrame, empty_answer: str = EMPTY_ANSWER
) -> DataFrame:
    """query_id, answer, is_truncated. An absent or empty completion becomes the fallback message;
    a cut-off one is kept and marked. A completion that was delivered twice counts once."""
    content = F.col("content")
    usable = F.coalesce(content != "", F.lit(False))
    once = one_completion(completions, ["query_id"])
    return queries.select("query_id").join(once, "query_id", "left").select(
        "query_id",
        F.when(usable, content).otherwise(F.lit(empty_answer)).alias("answer"),
        (usable & F.coalesce(F.col("finish_reason") == "length", F.lit(False))).alias(
            "is_truncated"
        ),
    )


def without_context(chunk: Column) -> Column:
    """The last line of a contextual chunk. Right only for texts without line breaks; `add_context`
    keeps the bare chunk in a column for all others."""
    return F.element_at(F.split(chunk, "\n"), -1)


def search_links(
    queries: DataFrame, results: DataFrame, search_url: str = VIDEO_SEARCH_URL
) -> DataFrame:
    """query_id, link for the queries without any result."""
    hits = results.select("query_id").distinct()
    encoded = F.replace(F.url_encode("query"), F.lit("+"), F.lit("%20"))
    return queries.join(hits, "query_id", "left_anti").select(
        "query_id", F.concat(F.lit(f"{search_url}="), encoded).alias("link")
    )
