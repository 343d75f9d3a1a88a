"""Transcripts from landings in mixed order."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from corpus_search.operators.embedding import hashed_embedder
from corpus_search.operators.ingest import classify_items, new_transcripts
from corpus_search.operators.lexical import bm25_scores
from corpus_search.operators.postings import current_scores
from corpus_search.plans.build import ingest_and_publish, open_lexical
from corpus_search.settings import IndexSettings
from corpus_search.sources.listing import listing_items
from corpus_search.sources.schemas import LISTING, SNIPPETS, TRANSCRIPTS, empty_table
from corpus_search.sources.snapshots import current_manifest, read_table
from corpus_search.sources.staging import staging_folder
from corpus_search.streaming.transcript_stream import run_transcripts

INDEX = IndexSettings(chunk_size=4, embedding_width=8)
EMBED = hashed_embedder(8)
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def listing(channel, *videos, date="2024-01-01T00:00:00Z"):
    items = [({"kind": "v", "videoId": v}, {"publishedAt": date, "title": f"Title {v}"}) for v in videos]
    return (channel, [{"id": a, "snippet": b} for a, b in items])


class Landing:
    def __init__(self, spark):
        self.spark, self.folder = spark, staging_folder(spark)
        self.root = f"{self.folder}/tables"
        self.listings, self.snippets = [], []
        self.land([], [])

    def land(self, listings, snippets):
        self.listings += listings
        self.snippets += snippets
        self.spark.createDataFrame(listings, LISTING).coalesce(1).write.mode("append").json(f"{self.folder}/listings")
        rows = self.spark.createDataFrame(snippets, SNIPPETS).withColumn("landed_at", F.lit(None).cast("timestamp"))
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/snippets")

    def run(self, minutes, quiet=90, checkpoint="checkpoint"):
        return run_transcripts(
            self.spark, f"{self.folder}/listings", f"{self.folder}/snippets", self.root,
            f"{self.folder}/{checkpoint}", INDEX, EMBED, START + timedelta(minutes=minutes), quiet * 60,
        )

    def stored(self):
        rows = read_table(self.spark, self.root, "transcripts").collect()
        assert len({r.video_id for r in rows}) == len(rows)
        return {tuple(r) for r in rows}

    def batch(self):
        """All that landed, at once."""
        items = listing_items(self.spark.createDataFrame(self.listings, LISTING))
        snippets = self.spark.createDataFrame(self.snippets, SNIPPETS)
        classified = classify_items(items, empty_table(self.spark, TRANSCRIPTS), snippets)
        return {tuple(r) for r in new_transcripts(classified, snippets).select(*TRANSCRIPTS.fieldNames()).collect()}


def test_landings_in_mixed_order_give_the_batch_result_once(spark):
    x = Landing(spark)
    x.land([listing("c1", "a", "b")], [("a", 2, "Third"), ("c", 1, "no item yet"), ("b", 0, "  ")])
    assert x.run(0).n_new == 0
    x.land([listing("c0", "a"), listing("c1", "c", "", "e"), listing("c2", "f", date="x")],
           [("a", 0, " First "), ("a", 2, "Third"), ("c", 0, "But"), ("f", 0, "unreadable date")])
    assert x.run(60).n_new == 0
    x.land([], [("a", 1, "second &amp; more"), ("b", 1, "Late text"), (None, None, None), ("a", None, "at the end")])
    assert x.run(120).n_new == 0
    done = x.run(300)
    assert done.n_new == 3 and done.n_rows == 1
    assert x.stored() == x.batch() and {r[0] for r in x.stored()} == {"a", "b", "c"}

    # What is done stays done; the rest completes when its text lands.
    x.land([listing("c9", "a")], [("a", 9, "too late"), ("e", 0, "text of e")])
    report = x.run(400)
    assert (report.n_new, report.n_late) == (0, 1)
    before = {r for r in x.stored()}
    assert x.run(600).n_new == 1
    assert {r[0] for r in x.stored() - before} == {"e"} and before < x.stored()

    chunks = read_table(spark, x.root, "chunks")
    scores = {tuple(r[:3]): round(r[3], 9) for r in bm25_scores(chunks).collect()}
    assert {tuple(r[:3]): round(r[3], 9) for r in current_scores(open_lexical(spark, x.root)).collect()} == scores


def test_a_run_reads_only_what_landed(spark):
    x = Landing(spark)
    x.land([listing("c", *[f"v{i}" for i in range(40)])], [(f"v{i}", s, f"w{s}") for i in range(40) for s in range(30)])
    assert x.run(0, 10).n_rows == 1 + 1200 + 1
    x.land([listing("c", "n")], [("n", 0, "new")])
    assert x.run(20, 10).n_rows == 1 + 1 + 1
    assert x.run(60, 10).n_rows == 1
    assert x.stored() == x.batch() and len(x.stored()) == 41
    assert current_manifest(spark, x.root)["version"] == 2


def test_a_batch_that_runs_again_adds_nothing(spark):
    x = Landing(spark)
    x.land([listing("c", "a")], [("a", 0, "text")])
    x.run(0, 10)
    x.run(60, 10)
    stored = x.stored()
    # A new checkpoint is a stream that has seen nothing: it finds what is stored.
    x.run(70, 10, "again")
    x.run(90, 10, "again")
    assert x.stored() == stored and len(stored) == 1


def test_the_stream_adds_to_an_index_that_was_built_before(spark):
    x = Landing(spark)
    x.land([listing("c", "a")], [("a", 0, "text of a")])
    items = listing_items(spark.createDataFrame(x.listings, LISTING))
    ingest_and_publish(spark, x.root, items, spark.createDataFrame(x.snippets, SNIPPETS), INDEX, EMBED)
    x.land([listing("c", "b")], [("b", 0, "text of b")])
    x.run(0, 10)
    x.run(60, 10)
    assert x.stored() == x.batch() and len(x.stored()) == 2
    chunks = read_table(spark, x.root, "chunks")
    assert current_scores(open_lexical(spark, x.root)).count() == bm25_scores(chunks).count()
