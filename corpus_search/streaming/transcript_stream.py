"""Transcripts put together as their pieces land, as a stateful stream.

Listings and snippets land in any order and in any number of files. Every video has its own state:
the snippets so far, the item that lists it, and whether it is done. A transcript is complete when
its video is listed, has text, and nothing of it has landed for a while; then it is handed on once,
and its snippets leave the state. So a run reads what has landed since the last one and nothing
else, and what it writes is as long as the transcripts it completes.

Time is the clock of the runs: each leaves a heartbeat (a row without a video) that moves the
watermark there, so that timers of earlier runs fire. Landed rows have no event time of their own
and are never late for Spark. Snippets of a done video are given as `late`; they change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpus_search.functions.text import clean, strip
from corpus_search.operators.embedding import Embedder
from corpus_search.operators.ingest import has_required_fields, parse_timestamp
from corpus_search.plans.build import encode_documents, increments, with_retries
from corpus_search.settings import IndexSettings
from corpus_search.sources.listing import listing_items
from corpus_search.sources.schemas import LISTING, SNIPPETS
from corpus_search.sources.snapshots import not_stored, publish, read_table
from corpus_search.sources.staging import stage, staging_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Landed snippets; only heartbeats have a time.
LANDED = T.StructType([*SNIPPETS.fields, T.StructField("landed_at", T.TimestampType())])

OUTPUT = (
    "video_id string, outcome string, channel_id string, published_at string, title string, "
    "text string, n_snippets long"
)
COLUMNS = [part.split()[0] for part in OUTPUT.split(", ")]


@dataclass(frozen=True)
class StreamReport:
    n_rows: int
    """landed rows that were read, heartbeat included"""
    n_new: int
    n_late: int


class Assembler(StatefulProcessor):
    """One video. `now` is the clock of the run, `quiet` how long nothing may land, both in ms."""

    def __init__(self, now: int, quiet: int):
        self.now, self.quiet = now, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.snippets = handle.getListState("snippets", "seq long, line string")
        self.item = handle.getValueState("item", "channel_id string, published_at string, title string")
        self.done = handle.getValueState("done", "is_done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n_late, landed = 0, False
        for part in rows:
            lines, items = part[part["line"].notna()], part[part["channel_id"].notna()]
            if self.done.exists():
                n_late += len(lines)
                continue
            landed = True
            if len(lines):
                self.snippets.appendList(
                    [(int(seq), line) for seq, line in zip(lines["seq"], lines["line"], strict=True)]
                )
            for found in items[["channel_id", "published_at", "title"]].itertuples(index=False):
                known = self.item.get()
                if known is None or tuple(found) < tuple(known):
                    self.item.update(tuple(found))
        if n_late:
            yield self._row(key[0], "late", (None, None, None), None, n_late)
        if landed:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(self.now + self.quiet)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        item = self.item.get()
        lines = sorted({tuple(row) for row in self.snippets.get()})
        text = " ".join(line for _, line in lines)
        # A blank transcript waits for more, as one that isn't listed does.
        if item is not None and text.strip():
            self.done.update((True,))
            self.snippets.clear()
            self.item.clear()
            yield self._row(key[0], "new", tuple(item), text, len(lines))

    def _row(self, video_id, outcome, item, text, n) -> pd.DataFrame:
        return pd.DataFrame([(video_id, outcome, *item, text, n)], columns=COLUMNS)

    def close(self) -> None:
        pass


def events(items: DataFrame, snippets: DataFrame) -> DataFrame:
    """Both landings as rows of one shape, a video's under its id. Items that lack a field or have
    an unreadable date never enter the state."""
    fields = ["channel_id", "published_at", "title"]
    listed = items.filter(
        has_required_fields() & parse_timestamp(F.col("published_at")).isNotNull()
    ).select(
        "video_id",
        F.lit(None).cast("bigint").alias("seq"),
        F.lit(None).cast("string").alias("line"),
        *fields,
        F.lit(None).cast("timestamp").alias("landed_at"),
    )
    # Snippets without a position are the first of their video.
    lines = snippets.select(
        F.coalesce("video_id", F.lit("")).alias("video_id"),
        F.coalesce("seq", F.lit(-(2**53))).alias("seq"),
        F.lower(strip(F.col("text"))).alias("line"),
        *[F.lit(None).cast("string").alias(field) for field in fields],
        "landed_at",
    )
    return listed.unionByName(lines).withWatermark("landed_at", "0 seconds")


def completed(landed: DataFrame, now: datetime, quiet_seconds: float) -> DataFrame:
    """The rows of `OUTPUT` for `events`: a `new` one for each transcript when it is complete."""
    processor = Assembler(round(now.timestamp() * 1000), round(quiet_seconds * 1000))
    return landed.groupBy("video_id").transformWithStateInPandas(
        processor, OUTPUT, outputMode="Append", timeMode="EventTime"
    )


def heartbeat(spark: SparkSession, snippets_path: str, now: datetime) -> None:
    spark.createDataFrame([(None, None, None, now)], LANDED).coalesce(1).write.mode(
        "append"
    ).parquet(snippets_path)


def run_transcripts(
    spark: SparkSession,
    listings_path: str,
    snippets_path: str,
    root: str,
    checkpoint: str,
    settings: IndexSettings,
    embedder: Embedder,
    now: datetime,
    quiet_seconds: float,
) -> StreamReport:
    """Read what landed since the last run and publish the transcripts that are complete by `now`,
    with their chunks and what they add to the lexical index. `now` may not go back from run to run.

    A batch that runs again after a failure is recognised by its number in the pointer file. Videos
    that were stored before the stream began are left out; without such, no stored row is read.
    """
    counted = {"new": 0, "late": 0}

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        folder = staging_folder(session)
        rows = stage(batch, f"{folder}/completed")
        documents = rows.filter(F.col("outcome") == "new").select(
            "video_id",
            parse_timestamp(F.col("published_at")).alias("creation_date"),
            clean(F.col("title")).alias("title"),
            clean(F.col("text")).alias("transcript"),
        )

        def once(manifest: dict) -> None:
            mark = manifest["streams"].get(checkpoint)
            if mark is not None and mark["batch"] >= batch_id:
                return
            at = f"{folder}/{manifest['version']}"
            has_older = mark["has_older"] if mark else "transcripts" in manifest["tables"]
            old = read_table(session, root, "transcripts", manifest)
            new = stage(not_stored(documents, old) if has_older else documents, f"{at}/documents")
            if new.isEmpty():
                return
            chunks = stage(encode_documents(new, settings, embedder), f"{at}/chunks")
            appended, replaced = increments(session, root, new, chunks, at, manifest)
            publish(
                session,
                root,
                {"transcripts": new, "chunks": chunks, **appended},
                replaced,
                ("bm25",),
                {checkpoint: {"batch": batch_id, "has_older": has_older}},
                manifest,
            )

        with_retries(once, session, root)
        many = F.when(F.col("outcome") == "late", F.col("n_snippets")).otherwise(1)
        for row in rows.groupBy("outcome").agg(F.sum(many).alias("n")).collect():
            counted[row["outcome"]] += row["n"]

    before = spark.conf.get(PROVIDER)
    heartbeat(spark, snippets_path, now)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        items = listing_items(spark.readStream.schema(LISTING).json(listings_path))
        snippets = spark.readStream.schema(LANDED).parquet(snippets_path)
        query = (
            completed(events(items, snippets), now, quiet_seconds)
            .writeStream.foreachBatch(process)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    n_rows = sum(progress["numInputRows"] for progress in query.recentProgress)
    return StreamReport(n_rows, counted["new"], counted["late"])
