"""Two publishers at a time, folders nobody needs, records nobody can read, rows delivered twice."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpus_search.operators import context, ingest, prompts, table_hashes
from corpus_search.operators.chunking import split_documents
from corpus_search.operators.embedding import embed_chunks, hashed_embedder
from corpus_search.operators.lexical import bm25_scores
from corpus_search.operators.postings import current_scores
from corpus_search.plans import build, derived
from corpus_search.settings import IndexSettings
from corpus_search.sources import snapshots
from corpus_search.sources.listing import read_landed
from corpus_search.sources.schemas import SNIPPETS, STORED_TABLES, TRANSCRIPTS, empty_table
from corpus_search.sources.staging import stage, staging_folder
from corpus_search.sources.tables import state_of

INDEX = IndexSettings(chunk_size=4, embedding_width=8)
EMBED = hashed_embedder(8)
DAY = "2024-01-01T00:00:00Z"


def documents(spark, *ids):
    return spark.createDataFrame([(i, None, f"Title {i}", f"text of {i}") for i in ids], TRANSCRIPTS)


def append(spark, root, *ids):
    rows = documents(spark, *ids)
    chunks = embed_chunks(split_documents(rows, INDEX), EMBED, 8)
    return build.append_documents(spark, root, rows, chunks, staging_folder(spark))


def stored(spark, root, table="transcripts"):
    return sorted(r.video_id for r in snapshots.read_table(spark, root, table).collect())


def test_of_two_publishers_one_begins_again_and_no_row_is_lost(spark, tmp_path, monkeypatch):
    root, publish, others = f"{tmp_path}/t", build.publish, [("b", "c"), ("c", "d")]

    def overtaken(*args, **named):
        # Another publisher is done while this one has computed its rows.
        if others:
            ids = others.pop(0)
            monkeypatch.setattr(build, "publish", publish)
            append(spark, root, *ids)
            monkeypatch.setattr(build, "publish", overtaken)
        return publish(*args, **named)

    append(spark, root, "x")
    monkeypatch.setattr(build, "publish", overtaken)
    assert append(spark, root, "a", "b", "d") == 4
    assert stored(spark, root) == ["a", "b", "c", "d", "x"]
    chunks = snapshots.read_table(spark, root, "chunks")
    got = current_scores(build.open_lexical(spark, root))
    key = lambda df: {tuple(r[:3]): round(r[3], 9) for r in df.collect()}
    assert key(got) == key(bm25_scores(chunks))


def test_a_conflict_changes_nothing(spark, tmp_path):
    root = f"{tmp_path}/t"
    base = snapshots.current_manifest(spark, root)
    assert snapshots.publish(spark, root, {"transcripts": documents(spark, "a")}, {}, base=base) == 1
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, root, {"transcripts": documents(spark, "b")}, {}, base=base)
    assert stored(spark, root) == ["a"]
    # The folder of the one that lost is nobody's.
    assert len(snapshots.clean(spark, root)) == 1
    assert stored(spark, root) == ["a"]


def test_cleaning_keeps_what_commits_and_leases_name(spark, tmp_path):
    root = f"{tmp_path}/t"
    for text in ("one", "two", "three"):
        scores = spark.createDataFrame([(text, 1, "x", 0.5)], STORED_TABLES["bm25"])
        snapshots.publish(spark, root, {"transcripts": documents(spark, text)}, {"bm25": scores})
    second = snapshots.manifest_of(spark, root, 2)
    lease = snapshots.take_lease(spark, root, second["tables"]["bm25"])
    snapshots.take_lease(spark, root, ["v=9-none"], seconds=-1)
    # Transcripts only grow, so all their folders are named; of the scores two are not.
    assert snapshots.clean(spark, root) == []
    assert stored(spark, root) == ["one", "three", "two"]
    assert stored(spark, root, "bm25") == ["three"]
    table = snapshots.read_table(spark, root, "bm25", second)
    assert [r.video_id for r in table.collect()] == ["two"]

    scores = [snapshots.read_table(spark, root, "bm25").withColumn("score", F.lit(x)) for x in (0.1, 0.2)]
    alone = f"{tmp_path}/alone"
    for df in scores:
        snapshots.publish(spark, alone, {}, {"bm25": df})
    first = snapshots.manifest_of(spark, alone, 1)["tables"]["bm25"][0].split("/")[0]
    assert snapshots.clean(spark, alone, keep=2) == []
    held = snapshots.take_lease(spark, alone, [first])
    assert snapshots.clean(spark, alone) == []
    snapshots.return_lease(spark, alone, held)
    assert snapshots.clean(spark, alone) == [first]
    assert snapshots.clean(spark, alone) == []
    assert snapshots.read_table(spark, alone, "bm25").first().score == 0.2
    snapshots.return_lease(spark, root, lease)


def test_records_that_cannot_be_read_are_counted(spark, tmp_path):
    def item(video="v", date=DAY, title="t"):
        return {"id": {"videoId": video, "kind": "k"}, "snippet": {"publishedAt": date, "title": title}}

    good = {"channel_id": "c1", "items": [item("a"), item(""), item("b", ""), item("c", DAY, ""), item("d", "soon")]}
    lines = [
        json.dumps(good),
        json.dumps(good)[:-3],
        json.dumps({"channel_id": "c2", "items": "none"}),
        "17",
        "",
        json.dumps({"channel_id": "c3"}),
    ]
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "one.json").write_text("\n".join(lines) + "\n")
    items, rejects = read_landed(spark, f"{tmp_path}/landing")
    assert sorted(r.video_id for r in items.collect()) == ["", "a", "b", "c", "d"]
    found = [(r.channel_id, r.video_id, r.reason) for r in rejects.collect()]
    assert sorted(found, key=str) == sorted(
        [
            ("c1", "", "missing_video_id"), ("c1", "b", "missing_published_at"), ("c1", "c", "missing_title"),
            ("c1", "d", "bad_date"), (None, None, "malformed_json"), ("c2", None, "wrong_type"),
            (None, None, "wrong_type"),
        ],
        key=str,
    )
    assert all(r.record and r.source.endswith("one.json") for r in rejects.collect())

    snippets = spark.createDataFrame([("a", 0, "text")], SNIPPETS)
    root = f"{tmp_path}/tables"
    report = build.ingest_and_publish(
        spark, root, items.drop("kind"), snippets, INDEX, EMBED, incremental=True, rejects=rejects
    )
    # The channel that only sent an unreadable record has failed, and so have records without one.
    assert (report.version, report.n_new, report.n_failed_channels) == (1, 1, 2)
    assert snapshots.read_table(spark, root, "rejects").count() == 7
    none = items.limit(0).drop("kind")
    with pytest.raises(RuntimeError, match="channels failed"):
        build.ingest_and_publish(
            spark, root, none, snippets, INDEX, EMBED, incremental=True,
            rejects=rejects.filter("reason = 'wrong_type'"),
        )


def test_one_gap_is_found_by_reading_one_bucket(spark, tmp_path):
    root = f"{tmp_path}/t"
    append(spark, root, *[f"d{i}" for i in range(300)])
    append(spark, root, *[f"e{i}" for i in range(300)])
    assert build.stored_issues(spark, root).collect() == []
    keys, hashes = (snapshots.read_table(spark, root, n) for n in ("keys", "hashes"))
    assert table_hashes.differing_buckets(hashes) == []

    # A version that lost the chunks of one document, and a chunk whose scores are gone.
    rows = documents(spark, "lost", "whole")
    chunks = split_documents(rows, INDEX)
    scored = bm25_scores(chunks)
    more = table_hashes.table_keys(rows, chunks.filter("video_id != 'lost'"), scored.filter("video_id != 'lost'"))
    keys, both = keys.unionByName(more), hashes.unionByName(table_hashes.key_hashes(more))
    buckets = table_hashes.differing_buckets(both)
    assert len(buckets) == 1
    found = table_hashes.issues_by_hashes(keys, both).collect()
    assert [tuple(r) for r in found] == [("transcript_without_chunk", "lost", None)]
    stage(keys.repartitionByRange(4, "bucket").sortWithinPartitions("bucket"), f"{tmp_path}/keys")
    plan = table_hashes.issues_by_hashes(spark.read.parquet(f"{tmp_path}/keys"), both)
    assert f"EqualTo(bucket,{buckets[0]})" in plan._jdf.queryExecution().executedPlan().toString()

    less = table_hashes.table_keys(rows, chunks, scored.limit(0))
    issues = table_hashes.issues_by_hashes(less, table_hashes.key_hashes(less)).collect()
    assert {tuple(r) for r in issues} == {("chunk_without_score", "lost", 1), ("chunk_without_score", "whole", 1)}
    orphan = table_hashes.table_keys(rows.filter("video_id != 'lost'"), chunks, scored)
    issues = table_hashes.issues_by_hashes(orphan, table_hashes.key_hashes(orphan)).collect()
    assert [tuple(r) for r in issues] == [("chunk_without_transcript", "lost", None)]


def test_completions_delivered_twice_count_once(spark):
    chunks = spark.createDataFrame(
        [("a", 1, "one"), ("a", 2, "two"), ("b", 1, "three")], "video_id string, chunk_index short, chunk string"
    )
    rows = [
        ("a", 1, "stop", "Context"), ("a", 1, "stop", "Context"), ("a", 2, "length", "cut"), ("a", 2, "stop", "whole"),
        ("b", 1, "stop", ""), ("b", 1, None, None),
    ]
    completions = spark.createDataFrame(
        rows, "video_id string, chunk_index short, finish_reason string, content string"
    )
    found = context.add_context(chunks, completions).sort("video_id", "chunk_index").collect()
    assert [(r.chunk, r.is_fallback) for r in found] == [
        ("context\none", False), ("whole\ntwo", False), ("three", True),
    ]
    queries = spark.createDataFrame([(1, "q"), (2, "r")], "query_id long, query string")
    answered = spark.createDataFrame(
        [(1, "length", "cut"), (1, "stop", "whole"), (1, "stop", "whole")],
        "query_id long, finish_reason string, content string",
    )
    got = prompts.answers(queries, answered, "none").sort("query_id").collect()
    assert [tuple(r) for r in got] == [(1, "whole", False), (2, "none", False)]


def test_texts_are_put_together_once(spark, tmp_path, monkeypatch):
    calls = []
    assemble = ingest.assemble_snippets
    monkeypatch.setattr(ingest, "assemble_snippets", lambda *a, **b: calls.append(1) or assemble(*a, **b))
    items = spark.createDataFrame(
        [("c", "a", DAY, "t"), ("c", "", DAY, "t"), ("c", None, DAY, "t")],
        "channel_id string, video_id string, published_at string, title string",
    )
    snippets = spark.createDataFrame([("a", 0, "text"), ("", 0, "of none")], SNIPPETS)
    build.ingest_and_publish(spark, f"{tmp_path}/t", items, snippets, INDEX, EMBED)
    assert calls == [1] and stored(spark, f"{tmp_path}/t") == ["a"]


def test_empty_tables_have_the_stored_types(spark):
    for name, schema in STORED_TABLES.items():
        table = empty_table(spark, schema)
        assert table.schema == schema and table.count() == 0, name
    both = snapshots.append_new(empty_table(spark, TRANSCRIPTS), documents(spark, "a"))
    assert both.schema == TRANSCRIPTS


def test_chunks_have_no_outer_blanks(spark):
    texts = [" \n\tone two\u3000three  four\u00a0 five six \u2003", "\u2028a\x85"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "video_id string, transcript string")
    found = [r.chunk for r in split_documents(rows, INDEX).sort("video_id", "chunk_index").collect()]
    assert found == ["one two three four", "five six", "a"]


def test_queries_of_any_length_find_the_documents_that_hold_them(spark):
    texts = {
        "a": "the quick brown fox jumps over the lazy dog near the river bank",
        "b": "a quick brownish fox",
        "c": "quick  brown fox",
        "d": "",
        "e": "the quick brown fox jumps over the lazy dog",
    }
    asked = [
        "quick", "uick brow", "k b", "fox", "x", "brown fox", "quick  brown", "the quick brown fox jumps over the lazy dog",
        "he quick brown fox jumps over the laz", "quick brown fox jumps over the lazy dog near the river", "none of it", "",
        "ck brown fox jumps over th",
    ]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    rows = spark.createDataFrame(list(texts.items()), "video_id string, transcript string")
    got = {tuple(r) for r in derived.holders(queries, rows).collect()}
    assert got == {(i, v) for i, q in enumerate(asked) for v, t in texts.items() if q.strip() and q in t}


def test_a_replaced_table_has_another_state(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(5).write.parquet(path)
    before = state_of(spark, path)
    assert before == state_of(spark, path)
    spark.range(6).write.mode("overwrite").parquet(path)
    assert state_of(spark, path) != before
    assert state_of(spark, f"{tmp_path}/none") == ()


def test_holders_meet_texts_without_shuffling_them(spark):
    words = [f"w{i}" for i in range(40)]
    others = [(f"other {i}", " ".join(f"v{i * j * 7919 % 99991}" for j in range(1, 30))) for i in range(1, 900)]
    held = [(str(i), " ".join(words[i : i + 30])) for i in range(10)]
    rows = spark.createDataFrame(held + others, "video_id string, transcript string")
    queries = spark.createDataFrame([(1, " ".join(words[9:20])), (2, "w3"), (2, "w4")], "query_id long, query string")
    folder = staging_folder(spark)
    rows, queries = stage(rows, f"{folder}/rows"), stage(queries, f"{folder}/queries")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20KB")
    try:
        found = derived.holders(queries, rows)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        got = {tuple(r) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    texts = {r.video_id: r.transcript for r in rows.collect()}
    assert got == {(q.query_id, v) for q in queries.collect() for v, t in texts.items() if q.query in t}


def test_a_batch_of_queries_needs_no_whole_search_rows(spark, tmp_path):
    words = [f"word{i}" for i in range(50)]
    docs = [(i, " ".join(words[(i * j) % 50] for j in range(1, 90)), "en", "s", 1) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(i, " ".join(words[i : i + 4])) for i in range(6)]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    index = derived.Index(spark, str(tmp_path))
    got = sorted(tuple(r) for r in index.scored().collect())
    assert "rows" not in vars(index)
    whole = derived.scored_candidates(
        index.prepared, index.knowledge, index.bm25, derived.SEARCH, derived.EMBEDDER, derived.RERANKER, index.rows
    )
    assert got and got == sorted(tuple(r) for r in whole.collect())
