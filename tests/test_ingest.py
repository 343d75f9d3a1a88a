from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpus_search.operators import ingest
from corpus_search.operators.embedding import hashed_embedder
from corpus_search.operators.lexical import bm25_scores
from corpus_search.plans.build import ingest_and_publish
from corpus_search.settings import IndexSettings
from corpus_search.sources import snapshots
from corpus_search.sources.listing import read_listings
from corpus_search.sources.schemas import SNIPPETS, TRANSCRIPTS, empty_table
from corpus_search.sources.tables import spread
from corpus_search.streaming.ingest_stream import run_ingest

INDEX = IndexSettings(chunk_size=4, embedding_width=8)
EMBED = hashed_embedder(8)
ITEM = "channel_id string, video_id string, published_at string, title string"
DAY = "2024-01-01T00:00:00Z"


def items(spark, rows):
    return spark.createDataFrame(rows, ITEM)


def snippets(spark, rows):
    return spark.createDataFrame(rows, SNIPPETS)


def test_timestamps(column):
    found = column(
        ["2024-01-01T10:00:00Z", "2024-01-01T10:00:00+02:00", "2024-01-01T10:00:00+0200", "x", ""],
        ingest.parse_timestamp(F.col("t")).cast("string"),
    )
    assert found == [
        "2024-01-01 10:00:00", "2024-01-01 08:00:00", "2024-01-01 08:00:00", None, None,
    ]


def test_newest_per_channel_with_one_channel_holding_most_items(spark):
    rows = [("big", f"v{i:04}", f"2024-01-01T{i // 60:02}:{i % 60:02}:00Z", "t") for i in range(900)]
    rows += [("small", "s1", DAY, "t"), ("small", "s2", "bad date", "t")]
    kept = ingest.newest_per_channel(items(spark, rows), 2).collect()
    assert {(r.channel_id, r.video_id) for r in kept} == {
        ("big", "v0899"), ("big", "v0898"), ("small", "s1"), ("small", "s2"),
    }


@pytest.mark.parametrize("block", [1, 2, 1_000])
def test_snippets_are_joined_in_order_and_once(spark, block):
    rows = [("a", 10, "  Hello "), ("a", 2, "WORLD"), ("a", 11, "x"), ("a", 11, "x"), ("b", 0, " ")]
    found = ingest.assemble_snippets(snippets(spark, rows), block).collect()
    assert {r.video_id: r.text for r in found} == {"a": "world hello x", "b": ""}


def test_outcomes_and_new_transcripts(spark):
    listed = items(
        spark,
        [
            ("c1", "", DAY, "t"), ("c1", "v0", "", "t"), ("c1", "v0", DAY, ""), ("c1", None, DAY, "t"),
            ("c1", "old", DAY, "t"), ("c1", "silent", DAY, "t"), ("c1", "blank", DAY, "t"),
            ("c2", "undated", "x", "t"), ("c2", "n1", DAY, "Second  &amp; title"),
            ("c1", "n1", DAY, "First  &amp; title"),
        ],
    )
    known = spark.createDataFrame([("old", None, "t", "x")], TRANSCRIPTS)
    texts = snippets(
        spark,
        [
            ("old", 0, "x"), ("blank", 0, " "), ("blank", 1, "\n"), ("undated", 0, "x"),
            ("n1", 0, "It&#39;s"), ("n1", 1, "a  b"), ("other", 0, "x"),
        ],
    )
    classified = ingest.classify_items(listed, known, texts)
    outcomes = classified.groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in outcomes} == {
        "missing_field": 4, "existing": 1, "unavailable": 1, "empty": 1, "rejected": 1, "new": 2,
    }
    added = ingest.new_transcripts(classified, texts).collect()
    assert [(r.video_id, r.title, r.transcript) for r in added] == [
        ("n1", "First & title", "it's a b")
    ]
    counts = ingest.channel_outcomes(classified)
    assert ingest.check_channels(counts) == (0, 2)
    with pytest.raises(RuntimeError, match="all 1 channels failed"):
        ingest.check_channels(counts.filter("channel_id = 'c2'").withColumn("n_new", F.lit(0)))
    assert ingest.check_channels(counts.limit(0)) == (0, 0)


def test_listing_source(spark, tmp_path):
    listing = {
        "channel_id": "c",
        "items": [
            {"id": {"videoId": "v", "kind": "k"}, "snippet": {"publishedAt": DAY, "title": "t"}},
            {"id": {"kind": "channel"}, "snippet": {"publishedAt": None}},
            {},
        ],
    }
    (tmp_path / "l.json").write_text(json.dumps(listing) + "\n" + json.dumps({"channel_id": "d"}))
    rows = read_listings(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("c", "", "", "", "channel"), ("c", "", "", "", "unknown"), ("c", "v", DAY, "t", "k"),
    ]


def test_runs_are_incremental_and_repeatable(spark, tmp_path):
    root = str(tmp_path / "tables")

    def run(ids):
        listed = items(spark, [("c", v, DAY, f"Title {v}") for v in ids])
        texts = snippets(spark, [(v, i, f"{v} word{i}") for v in ids for i in range(9)])
        return ingest_and_publish(spark, root, listed, texts, INDEX, EMBED)

    assert snapshots.read_table(spark, root, "chunks").count() == 0
    assert (run("ab").version, run("ab").n_new) == (1, 0)
    second = run("abc")
    assert (second.version, second.n_new) == (2, 1)
    chunks = snapshots.read_table(spark, root, "chunks")
    assert {r.video_id for r in chunks.select("video_id").distinct().collect()} == {"a", "b", "c"}
    stored = {tuple(r) for r in snapshots.read_table(spark, root, "bm25").collect()}
    fresh = {tuple(r) for r in bm25_scores(chunks).collect()}
    assert {r[:3] for r in stored} == {r[:3] for r in fresh}
    assert snapshots.read_table(spark, root, "transcripts").count() == 3


def test_a_run_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tables")
    listed = items(spark, [("c", "a", DAY, "t")])
    texts = snippets(spark, [("a", 0, "one two three")])
    ingest_and_publish(spark, root, listed, texts, INDEX, EMBED)

    def crash(*_):
        raise OSError("lost")

    more = items(spark, [("c", "b", DAY, "t")])
    more_texts = snippets(spark, [("b", 0, "four five")])
    with monkeypatch.context() as patched:
        patched.setattr(snapshots, "_commit", crash)
        with pytest.raises(OSError):
            ingest_and_publish(spark, root, more, more_texts, INDEX, EMBED)
    assert snapshots.current_manifest(spark, root)["version"] == 1
    assert snapshots.read_table(spark, root, "chunks").select("video_id").distinct().count() == 1
    assert ingest_and_publish(spark, root, more, more_texts, INDEX, EMBED).version == 2
    assert snapshots.read_table(spark, root, "chunks").count() == 2


def test_unchanged_tables_are_not_published(spark, tmp_path):
    root = str(tmp_path / "tables")
    scores = spark.createDataFrame(
        [("a", 1, "x", 0.5)], "video_id string, chunk_index short, token string, score double"
    )
    assert snapshots.publish(spark, root, {}, {"bm25": scores}) == 1
    assert snapshots.publish(spark, root, {}, {"bm25": scores.repartition(3)}) == 1
    changed = scores.withColumn("score", F.lit(0.6))
    assert snapshots.publish(spark, root, {}, {"bm25": changed}) == 2


def test_missing_folder_is_an_error_not_an_empty_table(spark, tmp_path):
    root = tmp_path / "tables"
    root.mkdir()
    manifest = {"version": 1, "tables": {"chunks": ["v=1/chunks"]}, "fingerprints": {}}
    (root / "_CURRENT").write_text(json.dumps(manifest))
    with pytest.raises(Exception, match="(?i)path"):
        snapshots.read_table(spark, str(root), "chunks").count()


def test_append_and_orders(spark):
    old = spark.createDataFrame([("a", None, "t", "x")], TRANSCRIPTS)
    both = snapshots.append_new(old, spark.createDataFrame([("a", None, "u", "y"), ("b", None, "t", "z")], TRANSCRIPTS))
    assert sorted((r.video_id, r.title) for r in both.collect()) == [("a", "t"), ("b", "t")]
    assert snapshots.append_new(empty_table(spark, TRANSCRIPTS), old).collect() == old.collect()
    dated = spark.sql(
        "select * from values ('b', timestamp'2024-01-01', '', ''), ('a', timestamp'2024-01-01', '', ''),"
        " ('c', timestamp'2025-01-01', '', '') t(video_id, creation_date, title, transcript)"
    )
    assert [r.video_id for r in snapshots.sorted_transcripts(dated).collect()] == ["c", "a", "b"]


def test_stream_ignores_files_delivered_again(spark, tmp_path):
    landing, texts = tmp_path / "landing", tmp_path / "snippets"
    landing.mkdir()
    snippets(spark, [(v, 0, f"words of {v}") for v in "abc"]).write.parquet(str(texts))

    def land(name, ids):
        listed = [
            {"id": {"videoId": v, "kind": "k"}, "snippet": {"publishedAt": DAY, "title": v}} for v in ids
        ]
        (landing / name).write_text(json.dumps({"channel_id": "c", "items": listed}))

    def run():
        run_ingest(
            spark, str(landing), str(texts), str(tmp_path / "tables"), str(tmp_path / "ck"), INDEX, EMBED
        )
        rows = snapshots.read_table(spark, str(tmp_path / "tables"), "transcripts").collect()
        return sorted(r.video_id for r in rows)

    land("1.json", "ab")
    assert run() == ["a", "b"]
    assert run() == ["a", "b"]
    land("2.json", "ab")
    land("3.json", "bc")
    assert run() == ["a", "b", "c"]


def test_spread_only_small_tables(spark):
    one_part = spark.range(10).coalesce(1)
    assert spread(one_part).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 10, 1, 9)
    assert spread(many) is many
