"""From listed items and landed snippets to new transcripts.

Every listed item ends with one outcome: missing_field, existing, unavailable, empty, rejected (its
date cannot be read) or new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_search.functions.text import clean, strip
from corpus_search.settings import MAX_LISTED
from corpus_search.sources.snapshots import not_stored

# Reasons of rejected records whose items never become rows, and the channel of those without one.
UNREADABLE = ["malformed_json", "wrong_type"]
UNKNOWN_CHANNEL = "(unreadable)"

OUTCOMES = ["missing_field", "existing", "unavailable", "empty", "rejected", "new"]

# Snippets are first joined into texts of this many positions, then the texts into the transcript,
# so that a very long transcript is not sorted snippet by snippet in one task.
SNIPPET_BLOCK = 1_000


def parse_timestamp(text: Column) -> Column:
    """`2024-01-01T00:00:00` followed by Z, +02:00 or +0200; null for anything else."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssxx")),
    )


def newest_per_channel(items: DataFrame, limit: int = MAX_LISTED) -> DataFrame:
    """The `limit` newest items of every channel, before any item is skipped. Each task keeps at
    most `limit` items per channel before the shuffle."""
    order = Window.partitionBy("channel_id").orderBy(
        F.desc_nulls_last(parse_timestamp(F.col("published_at"))), "video_id"
    )
    return (
        items.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
        .drop("position")
    )


def has_required_fields() -> Column:
    fields = ("video_id", "published_at", "title")
    present = [F.coalesce(F.col(field), F.lit("")) != "" for field in fields]
    return present[0] & present[1] & present[2]


def not_yet_ingested(items: DataFrame, transcripts: DataFrame) -> DataFrame:
    return not_stored(items, transcripts)


def assemble_snippets(snippets: DataFrame, block: int = SNIPPET_BLOCK) -> DataFrame:
    """video_id, text: the stripped, lower-cased snippets of a video in order. A snippet delivered
    twice counts once."""

    def joined(order: str, text: str) -> Column:
        rows = F.array_sort(F.collect_set(F.struct(order, text)))
        return F.array_join(F.transform(rows, lambda row: row[text]), " ")

    lines = snippets.select(
        "video_id",
        "seq",
        F.floor(F.col("seq") / block).alias("block"),
        F.lower(strip(F.col("text"))).alias("line"),
    )
    blocks = lines.groupBy("video_id", "block").agg(joined("seq", "line").alias("text"))
    return blocks.groupBy("video_id").agg(joined("block", "text").alias("text"))


def texts_of(items: DataFrame, snippets: DataFrame) -> DataFrame:
    """video_id, text of the listed videos. Items without an id have none."""
    listed = items.filter(F.coalesce("video_id", F.lit("")) != "").select("video_id")
    return assemble_snippets(snippets.join(listed, "video_id", "left_semi"))


def classify_items(
    items: DataFrame,
    transcripts: DataFrame,
    snippets: DataFrame | None = None,
    texts: DataFrame | None = None,
) -> DataFrame:
    """channel_id, video_id, title, creation_date, outcome for every listed item. Items without an
    id never reach a join. `texts` is the stored result of `texts_of`; without it the snippets are
    put together here."""
    complete = items.filter(has_required_fields())
    ids = complete.select("video_id")
    known = (
        transcripts.select("video_id")
        .join(ids, "video_id", "left_semi")
        .distinct()
        .withColumn("is_known", F.lit(True))
    )
    texts = texts_of(complete, snippets) if texts is None else texts
    blank = texts.select(
        "video_id", (strip(F.col("text")) == "").alias("is_blank")
    )
    created = parse_timestamp(F.col("published_at"))
    outcome = (
        F.when(F.col("is_known"), "existing")
        .when(F.col("is_blank").isNull(), "unavailable")
        .when(F.col("is_blank"), "empty")
        .when(created.isNull(), "rejected")
        .otherwise("new")
    )
    classified = (
        complete.join(known, "video_id", "left")
        .join(blank, "video_id", "left")
        .select(
            "channel_id",
            "video_id",
            "title",
            created.alias("creation_date"),
            outcome.alias("outcome"),
        )
    )
    incomplete = items.filter(~has_required_fields()).select(
        "channel_id",
        "video_id",
        "title",
        parse_timestamp(F.col("published_at")).alias("creation_date"),
        F.lit("missing_field").alias("outcome"),
    )
    return classified.unionByName(incomplete)


def new_transcripts(
    classified: DataFrame, snippets: DataFrame | None = None, texts: DataFrame | None = None
) -> DataFrame:
    """The transcripts to add: video_id, creation_date, title, transcript. A video listed by several
    channels is added once, as listed by the first of them."""
    first = F.min(F.struct("channel_id", "creation_date", "title"))
    new = (
        classified.filter(F.col("outcome") == "new")
        .groupBy("video_id")
        .agg(first.alias("listed"))
    )
    texts = texts_of(new, snippets) if texts is None else texts
    return new.join(texts, "video_id").select(
        "video_id",
        F.col("listed.creation_date").alias("creation_date"),
        clean(F.col("listed.title")).alias("title"),
        clean(F.col("text")).alias("transcript"),
    )


def channel_outcomes(classified: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """Items per channel and outcome, one row per channel. Records that could not be read count as
    rejected items of their channel; without a readable channel they are one of their own."""
    if rejects is not None:
        unread = rejects.filter(F.col("reason").isin(UNREADABLE)).select(
            F.coalesce("channel_id", F.lit(UNKNOWN_CHANNEL)).alias("channel_id"),
            F.lit("rejected").alias("outcome"),
        )
        classified = classified.select("channel_id", "outcome").unionByName(unread)
    return classified.groupBy("channel_id").agg(
        F.count("*").alias("n_items"),
        *[
            F.sum((F.col("outcome") == name).cast("int")).alias(f"n_{name}")
            for name in OUTCOMES
        ],
    )


def check_channels(outcomes: DataFrame) -> tuple[int, int]:
    """(failed, all) channels; raises when there are channels and all of them failed. A channel has
    failed when items were rejected and none of its items was usable."""
    failed = (F.col("n_rejected") > 0) & (F.col("n_new") + F.col("n_existing") == 0)
    n_failed, n_all = outcomes.agg(
        F.coalesce(F.sum(failed.cast("int")), F.lit(0)), F.count("*")
    ).first()
    if n_all and n_failed == n_all:
        raise RuntimeError(f"all {n_all} channels failed")
    return n_failed, n_all
