"""Batches of queries meet whole chunks: the rows of the joins, and no pair is shuffled."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_search.functions.arrays import run_lengths, word_counts
from corpus_search.operators import chunk_scoring, evaluation, postings, retrieval, tiled_scoring
from corpus_search.operators.batch_scoring import search_rows
from corpus_search.operators.lexical import bm25_scores
from corpus_search.operators.postings import current_candidates, lexical_delta
from corpus_search.operators.pruned_ranking import best_lexical
from corpus_search.plans import derived
from corpus_search.sources.staging import stage, staging_folder


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    chunks = [
        (f"d{i // 3}", i % 3, " ".join(["hot", *rng.choice(words, rng.integers(0, 12))])) for i in range(120)
    ]
    # One chunk stands in the table twice.
    chunks = spark.createDataFrame(
        [*chunks, chunks[5]], "video_id string, chunk_index smallint, chunk string"
    )
    folder = staging_folder(spark)
    vector = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(F.crc32("chunk") * i).cast("float"))
    knowledge = stage(chunks.withColumn("embedding", vector), f"{folder}/k")
    scores = stage(bm25_scores(chunks), f"{folder}/b")
    # A query's token comes twice, a query is in no chunk, and one has two vectors.
    asked = [(q, str(t)) for q in range(9) for t in rng.choice(words, 4, replace=False)]
    tokens = spark.createDataFrame([*asked, asked[0], (9, "nowhere"), (10, None)], "query_id long, token string")
    vectors = [(q, [float(x) for x in rng.normal(size=4)]) for q in [*range(10), 3]]
    vectors = spark.createDataFrame(vectors, "query_id long, query_embedding array<float>")
    return chunks, knowledge, scores, tokens, vectors


def rows(df):
    return sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture
def by_joins(monkeypatch):
    """The way of queries too many for a batch."""

    def run(get):
        with monkeypatch.context() as m:
            m.setattr(chunk_scoring, "MAX_QUERIES", 0)
            return rows(get())

    return run


@pytest.mark.parametrize("listed", [512, 2])
def test_pairs_are_those_of_joins(tables, by_joins, monkeypatch, listed):
    monkeypatch.setattr(chunk_scoring, "LISTED_QUERIES", listed)
    _, knowledge, scores, tokens, vectors = tables
    for get in (
        lambda: retrieval.lexical_candidates(scores, tokens),
        lambda: retrieval.lexical_passages(scores, tokens, knowledge, "chunk"),
        lambda: retrieval.lexical_similarities(scores, tokens, knowledge, vectors),
        lambda: evaluation.lexical_fusion(scores, tokens, knowledge, vectors, 7),
    ):
        assert rows(get()) == by_joins(get) != []


def test_no_pair_is_shuffled(tables):
    _, knowledge, scores, tokens, vectors = tables
    found = retrieval.lexical_similarities(scores, tokens, knowledge, vectors)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Pairs are listed last; no exchange and no join is above the explode.
    assert "Generate explode" in plan and "Exchange" not in plan[: plan.index("Generate explode")]


def test_postings_give_the_same_pairs(spark, tables, by_joins):
    chunks, _, scores, tokens, _ = tables
    index = lexical_delta(chunks, 1, staging_folder(spark))
    get = lambda: current_candidates(index, tokens)
    assert rows(get()) == by_joins(get) == rows(retrieval.lexical_candidates(scores, tokens))
    once = tokens.dropna().distinct()
    get = lambda: best_lexical(index, once, 5, staging_folder(spark)).best
    assert rows(get()) == by_joins(get) != []


def test_chunks_of_two_blocks_are_ranked_as_before(spark, tables, by_joins, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_BITS", 1)
    chunks, _, _, tokens, _ = tables
    chunks = chunks.unionByName(chunks.filter("chunk_index = 1"))
    index = lexical_delta(chunks, 1, staging_folder(spark))
    once = tokens.dropna().distinct()
    get = lambda: best_lexical(index, once, 5, staging_folder(spark), block_bits=1).best
    assert rows(get()) == by_joins(get) != []


def test_few_tiles_go_to_the_rows(tables):
    """Tiles that fit a batch meet the rows where they are; the rows are not copied for each."""
    _, knowledge, scores, tokens, vectors = tables
    words = tokens.dropna().groupBy("query_id").agg(F.collect_list("token").alias("words"))
    tiles, n_tiles = tiled_scoring.query_tiles(words, vectors, 2)
    assert n_tiles == 5
    got = tiled_scoring.best_by_tiles(search_rows(knowledge, scores), tiles, n_tiles, 4)
    assert "CoGroup" not in got._jdf.queryExecution().toString()
    assert got.count() > 0


def test_only_the_tables_that_are_read_are_built(spark, tmp_path):
    documents = [(1, "One two. Three", "en", "s", 14), (2, "Four five", "en", "s", 9)]
    spark.createDataFrame(
        documents, "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    index = derived.Index(spark, str(tmp_path))
    assert index.chunks.count() == 2
    assert set(vars(index)) == {"spark", "sf_dir", "folder", "transcripts", "chunks"}
    assert index.rows.count() == 2


def test_scores_are_built_without_vectors(spark, tmp_path):
    documents = [(1, "One two. Three", "en", "s", 14), (2, "Four five", "en", "s", 9)]
    spark.createDataFrame(
        documents, "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    alone, after = derived.Index(spark, str(tmp_path)), derived.Index(spark, str(tmp_path))
    assert after.chunks.count() == 2
    assert sorted(alone.bm25.collect()) == sorted(after.bm25.collect()) != []
    assert "chunks" not in vars(alone)


def test_words_are_counted_like_runs(spark):
    df = spark.createDataFrame([(["b", "a", "b", ""],), ([],), (None,), (["a"],)], "w array<string>")
    found = df.select(word_counts("w").alias("a"), run_lengths(F.col("w")).alias("b")).collect()
    got = [{r.value: r["count"] for r in row.a} for row in found]
    assert got == [{r.value: r["count"] for r in row.b or []} for row in found]
    assert got == [{"": 1, "a": 1, "b": 2}, {}, {}, {"a": 1}]
