"""Incremental ingest of landed listing files as a Structured Streaming job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpus_search.operators.embedding import Embedder
from corpus_search.plans.build import ingest_and_publish
from corpus_search.settings import IndexSettings
from corpus_search.sources.listing import listing_items
from corpus_search.sources.schemas import LISTING, SNIPPETS


def run_ingest(
    spark: SparkSession,
    landing: str,
    snippets_path: str,
    root: str,
    checkpoint: str,
    settings: IndexSettings,
    embedder: Embedder,
    max_listed: int | None = None,
    completions: DataFrame | None = None,
) -> None:
    """Process the listing files that landed since the last run, then stop.

    A batch publishes all three tables or nothing, and skips what is stored already. So a batch that
    runs again after a failure, or a file that is delivered again, adds nothing.
    """

    def process(listings: DataFrame, batch_id: int) -> None:
        session = listings.sparkSession
        snippets = session.read.schema(SNIPPETS).parquet(snippets_path)
        ingest_and_publish(
            session,
            root,
            listing_items(listings),
            snippets,
            settings,
            embedder,
            max_listed,
            completions,
        )

    query = (
        spark.readStream.schema(LISTING)
        .json(landing)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
