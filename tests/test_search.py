from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_search.functions.templates import split_template
from corpus_search.operators import (
    batch_scoring,
    evaluation,
    prompts,
    reranking,
    retrieval,
    spelling,
)
from corpus_search.operators.batch_scoring import (
    best_in_place,
    fits_batch,
    query_batch,
    search_rows,
)
from corpus_search.operators.chunking import split_documents
from corpus_search.operators.embedding import embed_chunks, embed_queries, hashed_embedder
from corpus_search.operators.knowledge import knowledge_base
from corpus_search.operators.lexical import bm25_scores
from corpus_search.plans.search import joined_candidates, search
from corpus_search.settings import IndexSettings, SearchSettings

WIDTH = 16
INDEX = IndexSettings(chunk_size=20, embedding_width=WIDTH)
EMBED = hashed_embedder(WIDTH)


def one_edit(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        differ = [i for i in range(len(a)) if a[i] != b[i]]
        return len(differ) == 1 or (
            len(differ) == 2
            and differ[1] == differ[0] + 1
            and a[differ[0]] == b[differ[1]]
            and a[differ[1]] == b[differ[0]]
        )
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(
        long[:i] + long[i + 1 :] == short for i in range(len(long))
    )


def test_corrections_match_brute_force(spark):
    random.seed(1)
    letters = "abé"
    entries = {
        "".join(random.choices(letters, k=random.randint(1, 6))): random.randint(1, 9)
        for _ in range(150)
    }
    asked = {"".join(random.choices(letters, k=random.randint(1, 7))) for _ in range(150)}
    dictionary = spark.createDataFrame(list(entries.items()), "word string, frequency long")
    words = spark.createDataFrame([(w,) for w in asked], "word string")
    found = {
        r.word: r.corrected for r in spelling.corrections(words, dictionary).collect()
    }
    expected = {}
    for word in asked - entries.keys():
        near = [e for e in entries if one_edit(word, e)]
        if near:
            expected[word] = min(near, key=lambda e: (-entries[e], e))
    assert found == expected


def prepare(spark, texts, dictionary_text):
    corpus = spark.createDataFrame([(dictionary_text,)], "transcript string")
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    return spelling.prepare_queries(queries, spelling.word_dictionary(corpus))


def test_prepared_queries(spark):
    rows = prepare(
        spark,
        ["Wolrd peaxe", "helo, world!", "hlelo", "hellow", "zzzzz 42 nan", "", "the the"],
        "hello world peace the 4 man",
    ).sort("query_id").collect()
    assert [r.corrected for r in rows] == [
        "world peace", "hello world", "hello", "hello", "zzzzz 42 nan", "", "the the",
    ]
    assert rows[5].words == []
    tokens = retrieval.query_tokens(spark.createDataFrame(rows)).filter("query_id = 6")
    assert tokens.count() == 1


@pytest.fixture(scope="module")
def corpus(spark):
    random.seed(2)
    words = [f"word{i}" for i in range(60)]

    def sentence(n):
        return " ".join(["hot", *random.choices(words, k=n)])

    documents = spark.createDataFrame(
        [(str(i), f"Title {i}", sentence(random.randint(1, 120))) for i in range(60)],
        "video_id string, title string, transcript string",
    )
    chunks = embed_chunks(split_documents(documents, INDEX), EMBED, WIDTH).persist()
    knowledge = knowledge_base(chunks, documents).persist()
    scores = bm25_scores(chunks).persist()
    queries = spark.createDataFrame(
        [(i, sentence(6) if i % 2 else f"word{i} word{i + 1}") for i in range(20)]
        + [(20, "nothing here"), (21, "")],
        "query_id long, query string",
    )
    prepared = spelling.prepare_queries(queries, spelling.word_dictionary(documents)).persist()
    return chunks, knowledge, scores, prepared


@pytest.mark.parametrize(
    ("cut", "is_small", "cells"), [(3, True, 2_000_000), (250, False, 2_000_000), (4, True, 100)]
)
def test_in_place_scoring_equals_joins_and_brute_force(
    spark, corpus, monkeypatch, cut, is_small, cells
):
    monkeypatch.setattr(batch_scoring, "CELLS", cells)
    chunks, knowledge, scores, prepared = corpus
    settings = SearchSettings(dense_cut=cut)
    columns = ["query_id", "dense_rank", "video_id", "chunk_index", "lexical_score", "cosine"]

    def rows(df):
        return [
            (*r[:4], pytest.approx(r[4]), pytest.approx(r[5], abs=1e-7))
            for r in df.select(*columns).sort("query_id", "dense_rank").collect()
        ]

    joined = joined_candidates(prepared, knowledge, scores, settings, EMBED, is_small)
    assert fits_batch(prepared)
    batch = query_batch(prepared, embed_queries(prepared, EMBED))
    in_place = best_in_place(search_rows(knowledge, scores), batch, cut)
    found = rows(in_place)
    assert found == rows(joined)

    vectors = {r.query_id: r.query_embedding for r in embed_queries(prepared, EMBED).collect()}
    everything = knowledge.join(
        scores.groupBy("video_id", "chunk_index").agg(F.collect_set("token").alias("tokens")),
        ["video_id", "chunk_index"],
    ).collect()
    for query in prepared.collect():
        near = []
        for r in everything:
            cosine = np.float32(round(float(np.dot(r.embedding, vectors[query.query_id])), 7))
            if set(query.words) & set(r.tokens) and cosine > 0:
                near.append((-cosine, r.video_id, r.chunk_index))
        expected = [(v, c) for _, v, c in sorted(near)[:cut]]
        assert [(f[2], f[3]) for f in found if f[0] == query.query_id] == expected


def test_search_is_the_same_in_place_and_by_joins(spark, corpus):
    chunks, knowledge, scores, prepared = corpus
    settings = SearchSettings(threshold=0.5)
    rerank = reranking.overlap_reranker()
    arguments = (prepared, knowledge, scores, settings, EMBED, rerank)
    by_joins = search(*arguments).sort("query_id", "rank").collect()
    in_place = search(*arguments, search_rows(knowledge, scores)).sort("query_id", "rank").collect()
    assert by_joins == in_place
    assert by_joins
    assert {r.query_id for r in by_joins} & {20, 21} == set()
    assert max(r.rank for r in by_joins) <= settings.k
    assert by_joins[0].url.startswith("https://youtu.be/")


def test_threshold_keeps_rows_exactly_at_the_limit(spark):
    rows = spark.createDataFrame([(0.9,), (0.89,), (0.95,)], "relevance float")
    kept = retrieval.above_threshold(rows, 0.9).collect()
    assert len(kept) == 2


def test_ties_are_broken_by_chunk(spark):
    rows = spark.createDataFrame(
        [(1, v, c, 0.5) for v in "ba" for c in (2, 1)],
        "query_id long, video_id string, chunk_index short, score double",
    )
    best = retrieval.best_per_query(rows, "score", 3).sort("rank").collect()
    assert [(r.video_id, r.chunk_index) for r in best] == [("a", 1), ("a", 2), ("b", 1)]


def test_titled_passage_is_null_without_title(column):
    assert column(["T", None], retrieval.titled_passage(F.col("t"), F.lit("C"))) == ["t: C", None]


def test_overlap_reranker_reads_a_limited_number_of_words(spark):
    rows = spark.createDataFrame([("red fox", "the red fox", "a b c red fox")], "q string, a string, b string")
    whole, limited = reranking.overlap_reranker(), reranking.overlap_reranker(max_words=3)
    scores = rows.select(
        whole(F.col("q"), F.col("a")), limited(F.col("q"), F.col("a")),
        limited(F.col("q"), F.col("b")),
    ).first()
    assert scores[0] == scores[1] > 0.99
    assert scores[2] < 0.01


def test_model_reranker_sees_batches(spark):
    def load():
        return lambda pairs: [len(pairs) / 10 + len(a) / 100 for a, _ in pairs]

    score = reranking.model_reranker(load, batch_size=2)
    rows = spark.createDataFrame([(i, "x" * i, "p") for i in range(3)], "i long, q string, p string")
    found = rows.coalesce(1).select("i", score(F.col("q"), F.col("p")).alias("s")).sort("i")
    assert [r.s for r in found.collect()] == pytest.approx([0.2, 0.21, 0.12])


RESULT = "query_id long, rank int, title string, url string, start double, end double, excerpt string"


def test_prompts(spark):
    results = spark.createDataFrame(
        [(1, 2, "B", "u2", 0.5, 1.0, "two"), (1, 1, "A", "u1", 0.0, 0.57, "one {query}")], RESULT
    )
    queries = spark.createDataFrame([(1, "Don't?"), (2, "a b&c")], "query_id long, query string")
    made = prompts.user_prompts(queries, results, "[{context}] {query}", "==").sort("query_id")
    first = (
        "[TITLE: A\nURL: u1\nSTART: 0.0\nEND: 0.57\nEXCERPT: one {query}\n==\n"
        "TITLE: B\nURL: u2\nSTART: 0.5\nEND: 1.0\nEXCERPT: two] Don't?"
    )
    assert [r.prompt for r in made.collect()] == [first, "[] a b&c"]
    links = prompts.search_links(queries, results, "https://x/s?q").collect()
    assert [tuple(r) for r in links] == [(2, "https://x/s?q=a%20b%26c")]
    system = prompts.system_prompts(queries).filter("query_id = 2").first().prompt
    assert "https://www.youtube.com/results?search_query=a b&c" in system


def test_answers(spark):
    queries = spark.createDataFrame([(i, "q") for i in range(4)], "query_id long, query string")
    completions = spark.createDataFrame(
        [(0, "stop", "yes"), (1, "length", "cut of"), (2, "stop", "")],
        "query_id long, finish_reason string, content string",
    )
    found = prompts.answers(queries, completions, "none").sort("query_id").collect()
    assert [(r.answer, r.is_truncated) for r in found] == [
        ("yes", False), ("cut of", True), ("none", False), ("none", False),
    ]


def test_context_prefix_is_stripped(column):
    assert column(["about x\nwords", "words"], prompts.without_context(F.col("t"))) == ["words"] * 2


@pytest.mark.parametrize(
    "template", ["{context}", "{context} {query} {other}", "{context} {query} {", "{context} {query} }"]
)
def test_template_contract(template):
    with pytest.raises(ValueError):
        split_template(template, {"context", "query"})
    assert split_template("{{}} {query}", {"query"}) == [("{", None), ("}", None), (" ", "query")]


def test_recall_and_sweep(spark):
    results = spark.createDataFrame(
        [(1, "a", 1), (1, "b", 3), (2, "x", 1)], "query_id long, video_id string, rank int"
    )
    labels = spark.createDataFrame(
        [(1, "a"), (1, "b"), (2, "y"), (3, "z")], "query_id long, video_id string"
    )
    found = {r.k: r for r in evaluation.recall_at(results, labels, [1, 3]).collect()}
    assert found[1].n_queries == 3
    assert found[1].recall == pytest.approx(0.5 / 3)
    assert found[3].recall == pytest.approx(1 / 3)
    assert found[3].hit_rate == pytest.approx(1 / 3)
    scored = results.withColumn("relevance", F.lit(0.9).cast("float"))
    sweep = evaluation.threshold_sweep(scored, labels, [0.9, 0.95]).sort("threshold").collect()
    assert [(r.n_kept, r.recall) for r in sweep] == [(3, 0.5), (0, 0.0)]


def test_rank_fusion(spark):
    rows = spark.createDataFrame(
        [(1, "a", 1, 3.0, 0.1), (1, "b", 1, 2.0, 0.9), (1, "c", 1, 1.0, 0.5)],
        "query_id long, video_id string, chunk_index short, lexical_score double, cosine double",
    )
    fused = evaluation.reciprocal_rank_fusion(rows, 2).sort("fused_rank").collect()
    assert [r.video_id for r in fused] == ["b", "a", "c"]
    assert fused[0].fused_score == pytest.approx(1 / 62 + 1 / 61)
