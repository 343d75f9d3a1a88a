from __future__ import annotations

import math
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpus_search.functions.arrays import run_lengths
from corpus_search.functions.skew import join_by_weight, join_salted
from corpus_search.functions.vectors import hashed_bag_of_words, l2_normalise, require_width
from corpus_search.operators import audit, context, embedding, lexical
from corpus_search.operators.chunking import documents_without_chunks, split_documents, truncate_documents
from corpus_search.operators.knowledge import knowledge_base, rounded
from corpus_search.settings import IndexSettings

SMALL = IndexSettings(chunk_size=20, embedding_width=8)


def documents(spark, texts):
    return spark.createDataFrame(
        [(str(i), f"Title {i}", text) for i, text in enumerate(texts)],
        "video_id string, title string, transcript string",
    )


def chunk_rows(spark, texts):
    return spark.createDataFrame(
        [(str(i), 1, text) for i, text in enumerate(texts)],
        "video_id string, chunk_index short, chunk string",
    )


@pytest.mark.parametrize("n_words", [0, 1, 18, 20, 21, 38, 39, 200])
def test_windows(spark, n_words):
    words = [f"w{i}" for i in range(n_words)]
    size, stride = SMALL.chunk_size, SMALL.stride
    chunks = split_documents(documents(spark, [" ".join(words)]), SMALL).sort("chunk_index")
    found = [(r.chunk_index, r.chunk.split()) for r in chunks.collect()]
    n_windows = 0 if n_words == 0 else 1 + max(0, math.ceil((n_words - size) / stride))
    assert len(found) == n_windows
    rebuilt = []
    for position, (index, chunk) in enumerate(found):
        assert index == position + 1
        assert chunk == words[position * stride : position * stride + size]
        rebuilt += chunk if position == 0 else chunk[SMALL.overlap :]
    assert rebuilt == words


def test_default_window_overlap():
    assert (IndexSettings().overlap, IndexSettings().stride) == (51, 461)


def test_truncation_and_documents_without_words(spark):
    settings = IndexSettings(chunk_size=4, max_document_tokens=5)
    rows = documents(spark, ["a b c d e f g", " \n ", ""])
    chunks = split_documents(rows, settings)
    assert [r.chunk for r in chunks.sort("chunk_index").collect()] == ["a b c d", "e f g"]
    cut = truncate_documents(rows, settings).sort("video_id").first()
    assert cut.transcript == "a b c d e"
    blank = documents_without_chunks(documents(spark, ["a", " \n ", "", None]))
    assert sorted(r.video_id for r in blank.collect()) == ["1", "2", "3"]


def reference_bm25(texts, k1=1.5, b=0.75):
    counts = [Counter(t for t in text.split(" ") if t) for text in texts]
    lengths = [len(text.split(" ")) for text in texts]
    average = sum(lengths) / len(lengths)
    df = Counter(token for count in counts for token in count)
    scores = {}
    for i, count in enumerate(counts):
        for token, tf in count.items():
            idf = math.log((len(texts) - df[token] + 0.5) / (df[token] + 0.5) + 1)
            scores[str(i), token] = (
                idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[i] / average))
            )
    return scores


@pytest.mark.parametrize("heavy_keys", [1, 3, 20_000])
def test_bm25_is_the_same_however_tokens_are_split(spark, heavy_keys):
    """One token holds a third of all rows; with 1 no token is broadcast, with 20,000 all are."""
    texts = ["hot " + " ".join(f"t{i}" for i in range(n % 4)) for n in range(30)] + ["", "hot hot"]
    scores = lexical.bm25_scores(
        chunk_rows(spark, texts), stop_words=(), heavy_keys=heavy_keys
    ).collect()
    expected = reference_bm25([text.strip() for text in texts])
    assert {(r.video_id, r.token) for r in scores} == set(expected)
    assert len(scores) == len(expected)
    for r in scores:
        assert r.score == pytest.approx(expected[r.video_id, r.token], rel=1e-12)
        assert r.score > 0


@pytest.mark.parametrize("limit", [0, 1_000])
def test_bm25_with_stored_frequencies(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(lexical, "BROADCAST_TOKENS", limit)
    texts = ["hot a b", "hot a", "hot", "c c d"]
    chunks = chunk_rows(spark, texts)
    found = lexical.build_bm25(chunks, str(tmp_path), stop_words=()).collect()
    expected = reference_bm25(texts)
    assert {(r.video_id, r.token): pytest.approx(r.score) for r in found} == expected


def test_blank_chunk_counts_one_token_and_stop_words_none(spark):
    tokens = lexical.chunk_tokens(chunk_rows(spark, ["", "the of", "cat cat dog"]))
    assert [r.n_tokens for r in tokens.sort("video_id").collect()] == [1, 0, 3]
    terms = lexical.term_frequencies(tokens).collect()
    assert {(r.token, r.tf) for r in terms} == {("cat", 2), ("dog", 1)}
    stats = lexical.corpus_statistics(tokens).first()
    assert stats.n_chunks == 3
    assert stats.avg_n_tokens == pytest.approx(4 / 3)


def test_run_lengths(spark):
    row = spark.range(1).select(
        run_lengths(F.array(*[F.lit(x) for x in "banana"])), run_lengths(F.array().cast("array<int>"))
    ).first()
    assert [(r.value, r["count"]) for r in row[0]] == [("a", 3), ("b", 1), ("n", 2)]
    assert row[1] is None


def test_join_by_weight_keeps_every_row_once(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), "id"
    )
    lookup = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    for heavy_keys in (1, 5, 10_000):
        joined = join_by_weight(rows, lookup, "key", "n", heavy_keys)
        assert joined.count() == 1000
        assert joined.filter("key = 'hot'").select("most").distinct().collect()[0][0] == 999


@pytest.mark.parametrize("heavy_keys", [1, 5, 10_000])
def test_join_salted_equals_a_plain_join(spark, heavy_keys):
    rows = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), "id"
    )
    others = spark.createDataFrame(
        [("hot", "a"), ("hot", "b"), ("1", "c"), ("absent", "d")], "key string, other string"
    )
    salted = join_salted(rows, others, "key", ["id"], heavy_keys, salts=4)
    assert sorted(salted.select("key", "id", "other").collect()) == sorted(
        rows.join(others, "key").select("key", "id", "other").collect()
    )


@pytest.mark.parametrize(("index", "count", "mark"), [(23, 40, 0.57), (29, 200, 0.14), (1, 1, 1.0)])
def test_marks_round_in_floating_point(spark, index, count, mark):
    found = spark.range(1).select(rounded(F.lit(index) / F.lit(count))).first()[0]
    assert found == mark


def test_knowledge_base(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (5, 60, 400)]
    docs = documents(spark, texts)
    chunks = embedding.embed_chunks(
        split_documents(docs, SMALL), embedding.hashed_embedder(8), 8
    )
    for heavy_keys in (1, 2, 1_000):
        rows = knowledge_base(chunks, docs.filter("video_id <> '1'"), heavy_keys).collect()
        assert {r.video_id for r in rows} == {"0", "2"}
        assert len(rows) == chunks.filter("video_id <> '1'").count()
        assert all(0 <= r.start < r.end <= 1 for r in rows)
        assert {r.title for r in rows} == {"Title 0", "Title 2"}


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([(["a", "b", "a"],), ([],)], "words array<string>")
    vectors = [np.array(r[0]) for r in rows.select(hashed_bag_of_words(F.col("words"), 16)).collect()]
    assert np.linalg.norm(vectors[0]) == pytest.approx(1)
    assert sorted(abs(vectors[0][vectors[0] != 0]) ** 2 * 5) == pytest.approx([1, 4])
    assert not vectors[1].any()


def test_task_prefix_is_no_word(spark):
    embed = embedding.hashed_embedder(16)
    rows = spark.createDataFrame([("green apples",)], "t string")
    bare, document, query = rows.select(
        embed(F.col("t")),
        embed(embedding.with_document_prefix(F.col("t"))),
        embed(embedding.with_query_prefix(F.col("t"))),
    ).first()
    assert bare == document == query


def test_zero_vector_stays_zero_and_wrong_width_fails(spark):
    rows = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    assert [r[0] for r in rows.select(l2_normalise(F.col("v"))).collect()] == [
        [0.0, 0.0], pytest.approx([0.6, 0.8]),
    ]
    with pytest.raises(PySparkException, match="width must be 3, got 2"):
        rows.select(require_width(F.col("v"), 3)).collect()


def test_model_embedder_loads_once_per_task_and_batches(spark):
    def load():
        return lambda texts: np.array([[len(texts), len(t)] for t in texts], dtype=float)

    embed = embedding.model_embedder(load, batch_size=2)
    rows = chunk_rows(spark, ["a", "bb", "ccc"]).coalesce(1)
    table = embedding.embed_chunks(rows, embed, 2).sort("video_id").collect()
    prefix = len("search_document: ")
    expected = np.array([[2, prefix + 1], [2, prefix + 2], [1, prefix + 3]], dtype=float)
    expected /= np.linalg.norm(expected, axis=1, keepdims=True)
    assert np.allclose([r.embedding for r in table], expected)


def test_context_merge(spark):
    chunks = chunk_rows(spark, ["c"] * 6)
    completions = spark.createDataFrame(
        [
            ("0", 1, "stop", "  About CATS \n"), ("1", 1, "length", "cut"), ("2", 1, "stop", None),
            ("3", 1, "stop", ""), ("4", 1, "stop", "  "),
        ],
        "video_id string, chunk_index short, finish_reason string, content string",
    )
    merged = context.add_context(chunks, completions).sort("video_id")
    assert [(r.chunk, r.is_fallback) for r in merged.collect()] == [
        ("about cats\nc", False), ("c", True), ("c", True), ("c", True), ("\nc", False), ("c", True),
    ]
    rates = context.fallback_rates(merged).agg(F.sum("n_fallbacks"), F.sum("n_chunks")).first()
    assert tuple(rates) == (4, 6)
    context.check_fallbacks(merged, 0.7)
    with pytest.raises(RuntimeError, match="no context"):
        context.check_fallbacks(merged, 0.5)


def test_context_prompts_do_not_expand_inserted_text(spark):
    docs = documents(spark, ["about {chunk} and {transcript}"])
    chunks = split_documents(docs, SMALL)
    prompt = context.context_prompts(docs, chunks, SMALL, "T:{transcript} C:{chunk}").first().prompt
    assert prompt == "T:about {chunk} and {transcript} C:about {chunk} and {transcript}"


def test_context_prompts_of_a_document_are_adjacent_and_ordered(spark):
    docs = documents(spark, [" ".join(f"w{i}" for i in range(200)) for _ in range(5)])
    chunks = split_documents(docs, SMALL).orderBy(F.rand(7))
    rows = context.context_prompts(docs, chunks, SMALL).collect()
    runs = [
        (video_id, [r.chunk_index for r in run])
        for video_id, run in groupby(rows, key=lambda r: r.video_id)
    ]
    n_chunks = chunks.count() // 5
    assert sorted(runs) == [(str(i), list(range(1, n_chunks + 1))) for i in range(5)]


def test_audit(spark):
    docs = documents(spark, ["cats run", "dogs run", " "])
    chunks = chunk_rows(spark, ["cats run"]).unionByName(
        spark.createDataFrame(
            [("0", 2, "the of"), ("0", 3, "birds"), ("9", 1, "lost")],
            "video_id string, chunk_index short, chunk string",
        )
    )
    bm25 = lexical.bm25_scores(chunks.filter("chunk <> 'birds'"))
    issues = {tuple(r) for r in audit.index_issues(docs, chunks, bm25).collect()}
    assert issues == {
        ("chunk_without_transcript", "9", None),
        ("transcript_without_chunk", "1", None),
        ("chunk_without_score", "0", 3),
    }
