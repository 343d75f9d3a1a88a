"""Spelling correction of query words at edit distance one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.functions.text import query_words

# Fixed value: words a number parser reads are never corrected and are no corrections.
NUMBER = r"^(\d+(e\d+)?|nan|inf|infinity)$"


def word_dictionary(texts: DataFrame, column: str = "transcript") -> DataFrame:
    """Words of the corpus with their frequency, written as query words are."""
    return (
        texts.select(F.explode(query_words(F.col(column))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("frequency"))
    )


def summed(words: DataFrame) -> DataFrame:
    """The dictionary of several versions' words."""
    return words.groupBy("word").agg(F.sum("frequency").alias("frequency"))


def with_variants(words: DataFrame, word: str, prefix: str) -> DataFrame:
    """A row for the word itself (position 0) and one for every way to delete one character."""
    text = F.col(word)
    deletions = F.transform(
        F.sequence(F.lit(1), F.char_length(text)),
        lambda at: F.struct(
            F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, 2**31 - 1))
            .alias("variant"),
            at.alias("position"),
            F.substring(text, at, F.lit(1)).alias("removed"),
        ),
    )
    whole = F.struct(
        text.alias("variant"), F.lit(0).alias("position"), F.lit("").alias("removed")
    )
    exploded = words.withColumn("v", F.explode(F.concat(F.array(whole), deletions)))
    return exploded.select(
        *words.columns,
        F.col("v.variant").alias("variant"),
        F.col("v.position").alias(f"{prefix}_position"),
        F.col("v.removed").alias(f"{prefix}_removed"),
    )


def one_edit_apart() -> Column:
    """Decides for two words with a common variant. Deleting at the same place is a replacement;
    deleting the same character at neighbouring places is a swap; an undeleted side is an insertion
    or a deletion."""
    left, right = F.col("query_position"), F.col("entry_position")
    swap = (F.abs(left - right) == 1) & (F.col("query_removed") == F.col("entry_removed"))
    return (left == 0) | (right == 0) | (left == right) | swap


def word_variants(words: DataFrame) -> DataFrame:
    """variant, candidate, entry_position, entry_removed: the deletions of dictionary words, to be
    stored. They depend on the word alone, so a table of them only grows by new words."""
    entries = words.filter(~F.col("word").rlike(NUMBER)).select(F.col("word").alias("candidate"))
    return with_variants(entries, "candidate", "entry").select(
        "variant", "candidate", "entry_position", "entry_removed"
    )


def corrections(
    words: DataFrame, dictionary: DataFrame, variants: DataFrame | None = None
) -> DataFrame:
    """word, corrected for every distinct word that needs a correction and has one: the most
    frequent dictionary word one edit away, the alphabetically first of equals.

    Both sides are matched by an equi-join on variants. The number of dictionary words that share
    one variant is bounded by the alphabet times the word length, so no key gets hot. With the
    stored `variants` of the dictionary (`word_variants`), only those of the unknown words are
    formed, and frequencies are looked up for the words that are one edit away. Without, dictionary
    words too long for any query word are left out before their variants are formed.
    """
    entries = dictionary.filter(~F.col("word").rlike(NUMBER))
    checked = words.select("word").distinct().filter(~F.col("word").rlike(NUMBER))
    known = entries.select("word").join(checked, "word", "left_semi")
    unknown = checked.join(known, "word", "left_anti")
    best = F.min(F.struct((-F.col("frequency")).alias("order"), "candidate"))
    if variants is not None:
        near = with_variants(unknown, "word", "query").join(variants, "variant")
        near = near.filter(one_edit_apart()).select("word", "candidate").distinct()
        counts = entries.select(F.col("word").alias("candidate"), "frequency")
        found = near.join(counts, "candidate").groupBy("word").agg(best.alias("best"))
        return found.select("word", F.col("best.candidate").alias("corrected"))
    longest = unknown.agg(F.max(F.char_length("word"))).scalar()
    reachable = entries.filter(F.char_length("word") <= longest + 1).select(
        F.col("word").alias("candidate"), "frequency"
    )
    pairs = with_variants(unknown, "word", "query").join(
        with_variants(reachable, "candidate", "entry"), "variant"
    )
    return (
        pairs.filter(one_edit_apart())
        .groupBy("word")
        .agg(best.alias("best"))
        .select("word", F.col("best.candidate").alias("corrected"))
    )


def prepare_queries(
    queries: DataFrame, dictionary: DataFrame, variants: DataFrame | None = None
) -> DataFrame:
    """query_id, query, corrected, words: the raw query, the corrected one and its words in order."""
    words = queries.select("query_id", F.posexplode(query_words(F.col("query")))).select(
        "query_id", F.col("pos").alias("position"), F.col("col").alias("word")
    )
    fixed = (
        words.join(corrections(words, dictionary, variants), "word", "left")
        .select("query_id", "position", F.coalesce("corrected", "word").alias("word"))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", "word"))).alias("ordered"))
        .select("query_id", F.col("ordered.word").alias("words"))
    )
    return queries.join(fixed, "query_id", "left").select(
        "query_id",
        "query",
        F.coalesce(F.array_join("words", " "), F.lit("")).alias("corrected"),
        F.coalesce("words", F.array().cast("array<string>")).alias("words"),
    )
