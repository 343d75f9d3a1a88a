"""What the registered queries write and shuffle: no more than the rows that are asked for."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpus_search.operators import batch_scoring, embedding, evaluation, tiled_scoring
from corpus_search.operators.postings import lexical_delta, matched_postings
from corpus_search.plans import build, catalogue, derived
from corpus_search.sources.snapshots import current_manifest, not_stored, read_table
from corpus_search.sources.staging import stage, staging_folder

WORDS = [f"word{i}" for i in range(40)]


@pytest.fixture
def data(spark, tmp_path):
    """Documents (one twice, one blank, one null), labels and queries."""
    texts = [" ".join(WORDS[(i * k) % 40] for k in range(1, 90 + i)) + ". The end" for i in range(1, 25)]
    documents = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    documents += [documents[3], (40, "", "en", "s", 0), (41, None, "en", "s", 0)]
    spark.createDataFrame(
        documents, "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 20, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    asked = [(q, " ".join(WORDS[(q * 7 + i) % 40] for i in range(5))) for q in range(6)]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.fixture
def no_broadcast(spark):
    """As if no table were small."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_the_audit_shuffles_no_score_by_its_token(spark, data, no_broadcast):
    got = catalogue.index_audit(spark, data)
    assert "hashpartitioning(token" not in plan_of(got)
    assert got.count() > 0 and rows(got) == rows(catalogue.audit_by_hashes(spark, data))


def test_searches_of_a_batch_build_rows_of_asked_tokens_only(spark, data):
    whole = derived.Index(spark, data)
    vectors = embedding.embed_queries(whole.prepared, derived.EMBEDDER)
    batch = batch_scoring.query_batch(whole.prepared, vectors)
    want = catalogue._dense_columns(batch_scoring.best_in_place(whole.rows, batch, derived.SEARCH.dense_cut))
    found = rows(catalogue.dense_top_in_place(spark, data))
    assert found == rows(want) != []
    built = vars(derived.index(spark, data))
    assert not {"rows", "knowledge", "bm25"} & set(built)

    tiles, n_tiles = tiled_scoring.query_tiles(whole.prepared, vectors)
    dense = tiled_scoring.best_by_tiles(whole.rows, tiles, n_tiles, 250, positive=False)
    fused = evaluation.fused_rankings(catalogue._pruned(spark, data, 250).best, dense, 250)
    fused = fused.select("query_id", "video_id", "chunk_index", catalogue.r6("fused_score").alias("score"))
    assert rows(catalogue.fusion_pruned(spark, data)) == rows(fused) != []
    assert not {"rows", "knowledge", "bm25"} & set(built)

    searched = rows(catalogue.search_by_tiles(spark, data))
    assert not {"rows", "bm25"} & set(built)
    assert searched == rows(catalogue.search(spark, data))


def test_the_dictionary_stores_no_texts(spark, data):
    index = derived.Index(spark, data)
    assert index.prepared.count() == 6 and "transcripts" not in vars(index)
    after = derived.Index(spark, data)
    assert after.transcripts.count() == 27
    assert rows(index.dictionary) == rows(after.dictionary) != []


def test_no_text_vector_or_posting_is_shuffled_to_be_published(spark, data, monkeypatch):
    ranged = []
    kind = type(spark.range(1))
    by_range = kind.repartitionByRange
    monkeypatch.setattr(
        kind, "repartitionByRange", lambda df, *keys: ranged.append(set(df.columns)) or by_range(df, *keys)
    )
    documents = derived.transcripts(spark, data)
    chunks = derived.embed_chunks(derived.split_documents(documents, derived.INDEX), derived.EMBEDDER, 64)
    root = f"{staging_folder(spark)}/tables"
    for part in range(2):
        some = [df.filter(F.crc32("video_id") % 2 == part) for df in (documents, chunks)]
        build.append_documents(spark, root, *some, staging_folder(spark))
    # Two versions order their chunks once, to number the blocks.
    assert sum("chunk" in columns for columns in ranged) == 2
    assert not any({"transcript", "entries", "candidate"} & columns for columns in ranged)
    assert rows(read_table(spark, root, "chunks").drop("embedding")) == rows(chunks.drop("embedding"))
    for folder in current_manifest(spark, root)["tables"]["chunks"]:
        of = spark.read.parquet(f"{root}/{folder}").withColumn("file", F.input_file_name())
        for (file,) in of.select("file").distinct().collect():
            keys = [tuple(r) for r in of.filter(F.col("file") == file).select("video_id", "chunk_index").collect()]
            assert keys == sorted(keys)


def test_new_rows_stay_where_they_are_when_few_are_stored(spark):
    old = stage(spark.range(1000).select(F.col("id").cast("string").alias("video_id")), f"{staging_folder(spark)}/old")
    new = spark.range(990, 1010).select(F.col("id").cast("string").alias("video_id"), F.lit("text").alias("transcript"))
    new = stage(new, f"{staging_folder(spark)}/new")
    got = not_stored(new, old, f"{staging_folder(spark)}/stored")
    assert "Exchange hashpartitioning" not in plan_of(got) and "SortMergeJoin" not in plan_of(got)
    assert rows(got) == rows(not_stored(new, old)) == [(str(i), "text") for i in range(1000, 1010)]


def test_postings_are_opened_where_they_stand(spark, data, no_broadcast):
    chunks = stage(derived.chunks(spark, data), f"{staging_folder(spark)}/chunks")
    index = lexical_delta(chunks, 1, staging_folder(spark))
    tokens = spark.createDataFrame([(1, "word3"), (2, "word5")], "query_id long, token string")
    blocks = stage(index.postings.select("block").distinct(), f"{staging_folder(spark)}/blocks")
    for some in (None, blocks):
        got = matched_postings(index, tokens, some)
        assert "REPARTITION" not in plan_of(got) and "SortMergeJoin [block" not in plan_of(got)
        assert got.count() > 0
