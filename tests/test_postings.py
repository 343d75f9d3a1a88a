"""The lexical index that grows by versions, pruned rankings and tiled scoring."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_search.operators import evaluation, retrieval, spelling
from corpus_search.operators.chunking import split_documents
from corpus_search.operators.embedding import embed_chunks, embed_queries, hashed_embedder
from corpus_search.operators.batch_scoring import search_rows
from corpus_search.operators.knowledge import co_bucketed_knowledge, knowledge_base
from corpus_search.operators.lexical import bm25_scores, build_bm25, chunk_tokens, term_frequencies
from corpus_search.operators.postings import (
    block_postings,
    current_candidates,
    current_scores,
    lexical_delta,
    merged,
    numbered_blocks,
    weighted_queries,
)
from corpus_search.operators.pruned_ranking import best_lexical, block_bounds, block_scores
from corpus_search.operators import tiled_scoring
from corpus_search.operators.quantised import _bounder, best_by_bounds, quantised
from corpus_search.operators.tiled_scoring import best_by_tiles, query_tiles
from corpus_search.plans import build
from corpus_search.plans.search import joined_candidates, search, tiled_candidates
from corpus_search.operators.reranking import overlap_reranker
from corpus_search.settings import IndexSettings, SearchSettings
from corpus_search.sources.buckets import declare, write_bucketed
from corpus_search.sources.snapshots import current_manifest, publish, read_table
from corpus_search.sources.staging import stage, staging_folder

WIDTH = 16
INDEX = IndexSettings(chunk_size=20, embedding_width=WIDTH)
EMBED = hashed_embedder(WIDTH)
TRANSCRIPTS = "video_id string, creation_date timestamp, title string, transcript string"


def documents_of(spark, texts, first=0):
    rows = [(f"d{first + i:04d}", f"Title {first + i}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "video_id string, title string, transcript string")
    return df.select("video_id", F.lit("2024-01-01").cast("timestamp").alias("creation_date"), "title", "transcript")


def chunks_of(documents):
    return embed_chunks(split_documents(documents, INDEX), EMBED, WIDTH)


def random_texts(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    # One word is in every text, the others become rare quickly.
    return [
        " ".join(["hot"] + rng.choices(words, weights=[1 / (i + 1) for i in range(80)], k=rng.randint(0, 90)))
        for _ in range(n)
    ]


def rounded(scores, column="score"):
    return {tuple(r[:-1]): round(r[-1], 9) for r in scores.select(*[c for c in scores.columns if c != column], column).collect()}


@pytest.fixture(scope="module")
def grown(spark):
    """Three versions, the last with blank texts and texts of stop words; and all in one table."""
    root = f"{staging_folder(spark)}/tables"
    parts = [random_texts(30), random_texts(25, 4), ["", "   ", "the and of", "hot hot hot", *random_texts(8, 5)]]
    first = 0
    for texts in parts:
        documents = documents_of(spark, texts, first)
        first += len(texts)
        build.append_documents(spark, root, documents, chunks_of(documents), staging_folder(spark))
    everything = stage(read_table(spark, root, "chunks"), f"{staging_folder(spark)}/chunks")
    return root, everything


def test_scores_of_three_versions_are_those_of_all_chunks(spark, grown):
    root, chunks = grown
    assert current_manifest(spark, root)["version"] == 3
    got = current_scores(build.open_lexical(spark, root))
    assert got.columns == ["video_id", "chunk_index", "token", "score"]
    assert rounded(got) == rounded(bm25_scores(chunks))
    assert rounded(current_scores(merged(build.open_lexical(spark, root)))) == rounded(bm25_scores(chunks))


def test_a_version_writes_no_more_than_its_documents_give(spark, grown):
    root, chunks = grown
    manifest = current_manifest(spark, root)
    assert [f.split("-")[0] for f in manifest["tables"]["postings"]] == ["v=1", "v=2", "v=3"]
    counts = [
        spark.read.parquet(f"{root}/{f}").agg(F.sum("n_entries")).first()[0]
        for f in manifest["tables"]["postings"]
    ]
    assert sum(counts) == bm25_scores(chunks).count()
    assert counts[2] < counts[0] / 2


def test_appending_the_same_documents_again_changes_nothing(spark, grown):
    root, _ = grown
    documents = documents_of(spark, random_texts(30))
    build.append_documents(spark, root, documents, chunks_of(documents), staging_folder(spark))
    assert current_manifest(spark, root)["version"] == 3


def test_frequencies_are_merged_after_many_versions(spark, monkeypatch):
    monkeypatch.setattr(build, "MAX_DELTAS", 2)
    root = f"{staging_folder(spark)}/tables"
    for i, text in enumerate(["a b b", "b c", "c d hot", "hot e"]):
        documents = documents_of(spark, [text], i)
        build.append_documents(spark, root, documents, chunks_of(documents), staging_folder(spark))
    tables = current_manifest(spark, root)["tables"]
    assert (len(tables["postings"]), len(tables["frequencies"]), len(tables["sums"])) == (4, 2, 2)
    chunks = read_table(spark, root, "chunks")
    assert rounded(current_scores(build.open_lexical(spark, root))) == rounded(bm25_scores(chunks))


def test_a_rebuilt_index_goes_over_to_increments(spark):
    root = f"{staging_folder(spark)}/tables"
    old = documents_of(spark, random_texts(10))
    chunks = stage(chunks_of(old), f"{staging_folder(spark)}/chunks")
    publish(spark, root, {"transcripts": old, "chunks": chunks}, {"bm25": build_bm25(chunks, staging_folder(spark))})
    new = documents_of(spark, random_texts(5, 9), 10)
    build.append_documents(spark, root, new, chunks_of(new), staging_folder(spark))
    assert "bm25" not in current_manifest(spark, root)["tables"]
    got = current_scores(build.open_lexical(spark, root))
    assert rounded(got) == rounded(bm25_scores(read_table(spark, root, "chunks")))
    with pytest.raises(ValueError):
        build.ingest_and_publish(spark, root, None, None, INDEX, EMBED)


def test_an_index_without_chunks_has_no_scores(spark):
    delta = lexical_delta(chunks_of(documents_of(spark, [])), 1, staging_folder(spark))
    assert current_scores(delta).collect() == []


@pytest.fixture(scope="module")
def asked(spark, grown):
    _, chunks = grown
    rng = random.Random(8)
    texts = [" ".join(["hot"] * (i % 2) + [f"w{rng.randrange(80)}" for _ in range(5)]) for i in range(30)]
    queries = spark.createDataFrame(
        list(enumerate([*texts, "", "unheard of"])), "query_id long, query string"
    )
    words = spelling.word_dictionary(chunks.select(F.col("chunk").alias("transcript")))
    return stage(spelling.prepare_queries(queries, words), f"{staging_folder(spark)}/prepared")


@pytest.mark.parametrize("is_small", [True, False])
def test_candidates_from_postings_equal_those_from_scores(spark, grown, asked, is_small):
    root, chunks = grown
    tokens = retrieval.query_tokens(asked)
    got = current_candidates(build.open_lexical(spark, root), tokens, is_small)
    want = retrieval.lexical_candidates(bm25_scores(chunks), tokens, True)
    assert rounded(got, "lexical_score") == rounded(want, "lexical_score")


def best_of_all(chunks, tokens, cut):
    scores = retrieval.lexical_candidates(bm25_scores(chunks), tokens, True)
    scores = scores.withColumn("lexical_score", F.rint(F.col("lexical_score") * 1e9) / 1e9)
    return retrieval.best_per_query(scores, "lexical_score", cut, "lexical_rank")


RANKED = ["query_id", "lexical_rank", "video_id", "chunk_index", "lexical_score"]


def ranked(df):
    return sorted(map(tuple, df.select(*RANKED).collect()))


@pytest.mark.parametrize("cut", [1, 7, 250])
def test_pruned_ranking_equals_the_full_one(spark, grown, asked, cut):
    root, chunks = grown
    tokens = retrieval.query_tokens(asked)
    got = best_lexical(build.open_lexical(spark, root), tokens, cut, staging_folder(spark))
    assert ranked(got.best) == ranked(best_of_all(chunks, tokens, cut))


def test_blocks_that_cannot_reach_the_best_are_never_opened(spark):
    """Topics fill neighbouring documents; a query of one topic opens few blocks. Equal texts tie."""
    topics = [[f"t{t}x{i}" for i in range(12)] for t in range(12)]
    rng = random.Random(6)
    texts = [
        " ".join(["hot", *rng.choices(topics[t], k=15)]) if i % 10 else "hot"
        for t in range(12)
        for i in range(300)
    ]
    documents = documents_of(spark, texts)
    chunks = stage(chunks_of(documents), f"{staging_folder(spark)}/chunks")
    index = lexical_delta(chunks, 1, staging_folder(spark))
    queries = [(q, t) for q in range(12) for t in ("hot", topics[q][0], topics[q][1])]
    tokens = spark.createDataFrame(queries, "query_id long, token string")
    got = best_lexical(index, tokens, 10, staging_folder(spark))
    assert ranked(got.best) == ranked(best_of_all(chunks, tokens, 10))
    n_blocks, n_scored = got.work.agg(F.sum("n_blocks"), F.sum("n_scored")).first()
    assert n_scored < n_blocks / 2


def test_bounds_hold(spark, grown, asked):
    root, _ = grown
    index = build.open_lexical(spark, root)
    tokens = stage(weighted_queries(index, retrieval.query_tokens(asked)), f"{staging_folder(spark)}/t")
    bounds = block_bounds(index, tokens)
    most = {}
    for block in [r.block for r in index.postings.select("block").distinct().collect()]:
        of = bounds.filter(F.col("block") == block)
        for r in block_scores(index, tokens, of).groupBy("query_id").agg(F.max("lexical_score")).collect():
            most[r[0], block] = r[1]
    limit = {(r.query_id, r.block): r.bound for r in bounds.collect()}
    assert limit.keys() == most.keys()
    assert all(limit[key] >= score - 1e-9 for key, score in most.items())


def test_stored_deletions_correct_like_the_whole_dictionary(spark, grown):
    """Deletions of a word are stored once, by the version that brought it; a batch of queries forms
    those of its own unknown words only."""
    root, _ = grown
    words = spelling.summed(read_table(spark, root, "words"))
    everything = read_table(spark, root, "transcripts")
    counts = lambda df: sorted(map(tuple, df.select("word", "frequency").collect()))
    assert counts(words) == counts(spelling.word_dictionary(everything))
    variants = read_table(spark, root, "variants")
    assert variants.count() == variants.distinct().count() == spelling.word_variants(words).count()
    rng = random.Random(5)
    letters = "w0123456789hot"
    asked = spark.createDataFrame(
        [("".join(rng.choices(letters, k=rng.randint(1, 5))),) for _ in range(300)], "word string"
    )
    got = spelling.corrections(asked, words, variants)
    want = spelling.corrections(asked, words)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


# Tiles


@pytest.fixture(scope="module")
def opened(spark, grown):
    root, chunks = grown
    folder = staging_folder(spark)
    knowledge = stage(knowledge_base(chunks, read_table(spark, root, "transcripts")), f"{folder}/k")
    scores = stage(bm25_scores(chunks), f"{folder}/b")
    return knowledge, scores, stage(search_rows(knowledge, scores), f"{folder}/r")


def dense(df):
    return sorted(
        (r.query_id, r.dense_rank, r.video_id, r.chunk_index, round(r.cosine, 6), round(r.lexical_score, 9))
        for r in df.collect()
    )


@pytest.mark.parametrize(("tile_queries", "part_rows", "cells"), [(4, 20, 50), (4096, 8192, 2_000_000), (1, 1000, 7)])
def test_tiles_equal_joins(spark, opened, asked, tile_queries, part_rows, cells):
    knowledge, scores, rows = opened
    settings = SearchSettings(dense_cut=9)
    tiles, n = query_tiles(asked, embed_queries(asked, EMBED), tile_queries)
    assert n == max(1, -(-31 // tile_queries))
    got = best_by_tiles(rows, tiles, n, 9, part_rows, cells)
    assert dense(got) == dense(joined_candidates(asked, knowledge, scores, settings, EMBED))


def test_tiles_without_a_limit_on_the_cosine(spark, opened, asked):
    knowledge, scores, rows = opened
    tiles, n = query_tiles(asked, embed_queries(asked, EMBED), 10)
    got = best_by_tiles(rows, tiles, n, 40, positive=False)
    similar = retrieval.with_cosine(
        retrieval.lexical_candidates(scores, retrieval.query_tokens(asked), True),
        knowledge,
        embed_queries(asked, EMBED),
    )
    want = retrieval.best_per_query(similar, "cosine", 40, "dense_rank")
    assert dense(got) == dense(want)


def test_tiles_of_no_queries_and_no_rows(spark, opened, asked):
    _, _, rows = opened
    for some, of in ((asked.limit(0), rows), (asked, rows.limit(0))):
        tiles, n = query_tiles(some, embed_queries(some, EMBED))
        assert best_by_tiles(of, tiles, n, 5).collect() == []


def random_part(n_rows, n_queries, seed, copies=1):
    """Chunks with equal vectors among them, and queries, as the block products get them."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(30)]
    vectors = rng.integers(-2, 3, size=(n_rows, 8)).astype(np.float32)
    vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)).astype(np.float32)
    rows = pa.table(
        {
            "video_id": [f"v{i * 7 % n_rows // copies}" for i in range(n_rows)],
            "chunk_index": pa.array([i * 7 % n_rows % copies for i in range(n_rows)], pa.int16()),
            "tokens": [rng.choice(words, rng.integers(0, 4)).tolist() for _ in range(n_rows)],
            "embedding": pa.array(vectors.tolist(), pa.list_(pa.float32())),
        },
    )
    rows = rows.set_column(2, "tokens", rows.column("tokens").cast(pa.list_(pa.string())))
    scores = [[round(float(x), 3) for x in rng.random(len(t))] for t in rows.column("tokens").to_pylist()]
    rows = rows.append_column("scores", pa.array(scores, pa.list_(pa.float64())))
    asked = [rng.choice([*words, "none"], 3).tolist() for _ in range(n_queries)]
    queries = pa.table(
        {"query_id": range(n_queries), "words": asked, "query_embedding": vectors[:n_queries].tolist()}
    )
    return rows, queries


@pytest.mark.parametrize("positive", [True, False])
@pytest.mark.parametrize(("cells", "cut"), [(40, 3), (100_000, 3), (300, 1000)])
def test_a_part_hands_on_a_querys_best_rows_and_no_more(cells, cut, positive):
    """Not what was among the best when it was met: that grows with the number of steps."""
    rows, queries = random_part(400, 12, 3, copies=2)
    got = tiled_scoring._scorer(cut, cells, positive)(rows, queries).to_pylist()
    own = [tuple(r.values()) for r in rows.select(["video_id", "chunk_index", "tokens", "scores", "embedding"]).to_pylist()]
    want = []
    for q in queries.to_pylist():
        pairs = []
        for video_id, chunk_index, tokens, scores, vector in own:
            cosine = np.float32(np.rint(np.dot(vector, q["query_embedding"]) * 1e7) / 1e7)
            if set(tokens) & set(q["words"]) and (cosine > 0 or not positive):
                lexical = sum(s * q["words"].count(t) for t, s in zip(tokens, scores, strict=True))
                pairs.append((-cosine, video_id, chunk_index, round(lexical, 9)))
        want += [(q["query_id"], v, c, s, -x) for x, v, c, s in sorted(pairs)[:cut]]
    assert sorted(
        (r["query_id"], r["video_id"], r["chunk_index"], round(r["lexical_score"], 9), np.float32(r["cosine"]))
        for r in got
    ) == sorted(want)


def test_bounds_of_a_part_leave_what_its_last_bounds_allow(spark):
    """A pair is dropped by the part's final bound, also if it was met before that was known."""
    rows, queries = random_part(600, 10, 5)
    schema = "video_id string, chunk_index short, tokens array<string>, embedding array<float>, scores array<double>"
    coded = quantised(spark.createDataFrame([tuple(r.values()) for r in rows.to_pylist()], schema)).toArrow()
    few = _bounder(4, 50)(coded, queries).to_pylist()
    all_at_once = _bounder(4, 10**6)(coded, queries).to_pylist()
    pairs = lambda out: sorted((r["query_id"], r["video_id"], r["n_matched"] or 0) for r in out if r["video_id"])
    assert pairs(few) == pairs(all_at_once)
    for out in (few, all_at_once):
        for q in range(10):
            own = [r for r in out if r["query_id"] == q and r["video_id"]]
            least = sorted((r["lower"] for r in own), reverse=True)[:4]
            assert len(own) < 4 or all(r["upper"] >= least[-1] for r in own)
    counts = {r["query_id"]: r["n_matched"] for r in few if r["video_id"] is None}
    for q in queries.to_pylist():
        assert counts[q["query_id"]] == sum(bool(set(t) & set(q["words"])) for t in rows.column("tokens").to_pylist())


def test_a_search_of_twenty_thousand_queries(spark, opened):
    """More than a batch holds: scored in tiles, with the rows of the joins and no table of pairs."""
    knowledge, scores, rows = opened
    rng = random.Random(4)
    prepared = spark.createDataFrame(
        [(i, " ".join(w := rng.sample([f"w{j}" for j in range(80)], 3)), w) for i in range(20_000)],
        "query_id long, corrected string, words array<string>",
    ).withColumn("query", F.col("corrected"))
    prepared = stage(prepared, f"{staging_folder(spark)}/many")
    settings = SearchSettings(k=1, threshold=0.5, dense_cut=2)
    tiled = tiled_candidates(prepared, rows, settings, EMBED)
    joined = joined_candidates(prepared, knowledge, scores, settings, EMBED)
    assert dense(tiled) == dense(joined)
    plan = tiled._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "lexical_score" in plan and "SortMergeJoin [token" not in plan
    both = [
        search(prepared, knowledge, scores, settings, EMBED, overlap_reranker(), of) for of in (rows, None)
    ]
    assert sorted(map(tuple, both[0].collect())) == sorted(map(tuple, both[1].collect()))


def test_fusion_of_rankings_that_were_found_apart(spark, grown, opened, asked):
    root, _ = grown
    knowledge, scores, rows = opened
    vectors = embed_queries(asked, EMBED)
    tokens = retrieval.query_tokens(asked)
    similar = retrieval.with_cosine(retrieval.lexical_candidates(scores, tokens, True), knowledge, vectors)
    want = evaluation.reciprocal_rank_fusion(similar, 12)
    lexical = best_lexical(build.open_lexical(spark, root), tokens, 12, staging_folder(spark)).best
    tiles, n = query_tiles(asked, vectors)
    got = evaluation.fused_rankings(lexical, best_by_tiles(rows, tiles, n, 12, positive=False), 12)
    columns = ["query_id", "fused_rank", "video_id", "chunk_index", "fused_score"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


# Quantised vectors


@pytest.mark.parametrize(("tile_queries", "part_rows", "cells", "cut"), [(4, 20, 50, 9), (4096, 8192, 2_000_000, 250)])
def test_bounds_give_the_exact_top(spark, opened, asked, tile_queries, part_rows, cells, cut):
    knowledge, scores, rows = opened
    folder = staging_folder(spark)
    tiles, n = query_tiles(asked, embed_queries(asked, EMBED), tile_queries)
    tiles = stage(tiles, f"{folder}/tiles")
    coded = stage(quantised(rows), f"{folder}/coded")
    got = best_by_bounds(coded, rows, tiles, n, cut, folder, part_rows, cells)
    settings = SearchSettings(dense_cut=cut)
    assert dense(got.best) == dense(joined_candidates(asked, knowledge, scores, settings, EMBED))


def test_most_products_are_ruled_out_by_their_bounds(spark):
    rng = np.random.default_rng(3)

    def unit(n):
        x = rng.normal(size=(n, 32))
        return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).tolist()

    chunks = [(f"v{i}", 1, ["hot", f"t{i % 3}"], [0.5, 1.0], v) for i, v in enumerate(unit(3000))]
    chunks.append(("zero", 1, ["hot"], [0.5], [0.0] * 32))
    rows = spark.createDataFrame(
        chunks, "video_id string, chunk_index short, tokens array<string>, scores array<double>, embedding array<float>"
    )
    asked = [(q, ["hot"] if q % 2 else ["t1", "none"], v) for q, v in enumerate(unit(20))]
    tiles = spark.createDataFrame(asked, "query_id long, words array<string>, query_embedding array<float>")
    tiles = tiles.withColumn("tile", F.lit(0))
    folder = staging_folder(spark)
    coded = stage(quantised(rows), f"{folder}/coded")
    got = best_by_bounds(coded, rows, tiles, 1, 10, folder, 1000)
    assert dense(got.best) == dense(best_by_tiles(rows, tiles, 1, 10))
    n_matched, n_exact = got.work.agg(F.sum("n_matched"), F.sum("n_exact")).first()
    assert n_matched == 10 * 3001 + 10 * 1000
    assert n_exact < n_matched / 50
    real = {r.video_id: np.array(r.embedding) for r in rows.collect()}
    for r in coded.collect():
        code = np.frombuffer(r.code, np.int8) * r.scale
        assert np.linalg.norm(real[r.video_id] - code) <= r.loss < 0.02


# Buckets


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange")


def test_joins_of_tables_with_the_same_buckets_need_no_exchange(spark, grown):
    root, chunks = grown
    transcripts = read_table(spark, root, "transcripts")
    folder = staging_folder(spark)
    a, b = write_bucketed(chunks, f"{folder}/a", 3), write_bucketed(transcripts, f"{folder}/b", 3)
    got = co_bucketed_knowledge(a, b)
    want = knowledge_base(chunks, transcripts)
    key = lambda df: sorted(tuple(r)[:6] for r in df.collect())
    assert key(got) == key(want)
    assert exchanges(got) == 0 < exchanges(want)
    new = b.join(a.select("video_id").hint("merge"), "video_id", "left_anti")
    assert exchanges(new) == 0 and new.count() == 2

    # Another session finds the buckets again.
    other = spark.newSession()
    c = declare(other, f"{folder}/a", ", ".join(f"{n} {t}" for n, t in a.dtypes), 3)
    assert exchanges(c.groupBy("video_id").count()) == 0 and c.count() == chunks.count()


def test_computed_chunks_are_computed_once(spark):
    """The encoder of a version's chunks runs once for every chunk, whatever is looked up about them."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    root = f"{staging_folder(spark)}/tables"
    for first in (0, 20):
        documents = documents_of(spark, random_texts(20, 3 + first), first)
        chunks = chunks_of(documents)
        n = chunks.count()
        before = seen.value
        computed = chunks.mapInArrow(counted, chunks.schema)
        build.append_documents(spark, root, documents, computed, staging_folder(spark))
        assert seen.value - before == n


def test_postings_are_put_together_where_blocks_stand(spark):
    """Blocks that Arrow batches cut are whole again; only the order of the chunks is shuffled."""
    chunks = stage(chunks_of(documents_of(spark, [*random_texts(90), "", "hot the"])), f"{staging_folder(spark)}/chunks")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        index = lexical_delta(chunks, 2, staging_folder(spark))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    rows = index.postings.collect()
    assert len({(r.token, r.block) for r in rows}) == len(rows)
    assert all(r.n_entries == len(r.entries) <= 128 for r in rows)
    assert all(r.most == max(e.tf for e in r.entries) and r.shortest == min(e.n_tokens for e in r.entries) for r in rows)
    assert all(list(r.entries) == sorted(r.entries) for r in rows)
    got = sorted((e.video_id, e.chunk_index, e.n_tokens, r.token, e.tf) for r in rows for e in r.entries)
    tokens = stage(chunk_tokens(chunks), f"{staging_folder(spark)}/tokens")
    want = term_frequencies(tokens).select("video_id", "chunk_index", "n_tokens", "token", "tf")
    assert got == sorted(map(tuple, want.collect()))
    assert index.sums.first() == tokens.agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens")).first()
    plan = block_postings(numbered_blocks(chunks, 1))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


# Rows past tiles


@pytest.fixture
def past_tiles_only(monkeypatch):
    """No batch is broadcast, and rows are packed by a few."""
    monkeypatch.setattr(tiled_scoring, "MAX_QUERIES", 0)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("tile_queries", "part_rows", "cells"), [(4, 20, 50), (100, 7, 2_000_000)])
@pytest.mark.parametrize("positive", [True, False])
def test_rows_read_past_tiles_are_not_copied(spark, opened, asked, past_tiles_only, tile_queries, part_rows, cells, positive):
    """Rows of several parts are read by the tiles; no copy of them is shuffled for a tile."""
    knowledge, scores, rows = opened
    vectors = embed_queries(asked, EMBED)
    tiles, n = query_tiles(asked, vectors, tile_queries)
    got = best_by_tiles(rows, tiles, n, 9, part_rows, cells, positive)
    plan = plan_of(got)
    assert "CartesianProduct" in plan and "CoGroup" not in plan and "explode" not in plan
    similar = retrieval.with_cosine(
        retrieval.lexical_candidates(scores, retrieval.query_tokens(asked), True), knowledge, vectors
    )
    want = similar.filter("cosine > 0") if positive else similar
    assert dense(got) == dense(retrieval.best_per_query(want, "cosine", 9, "dense_rank")) != []


def tied_rows(spark):
    """More equal chunks than are wanted, in parts that stand in no order, with keys that come twice."""
    rng = np.random.default_rng(4)
    order = rng.permutation(400)
    rows = [
        (f"v{i % 97}", int(i % 5), ["hot", f"t{i % 3}"], [0.5, 1.0 + i % 3], [0.6, 0.8] if i % 4 else [0.8, 0.6])
        for i in order.tolist()
    ]
    rows = spark.createDataFrame(
        rows, "video_id string, chunk_index short, tokens array<string>, scores array<double>, embedding array<float>"
    )
    asked = [(q, ["hot"] if q % 2 else [f"t{q % 3}", "none"], [1.0, 0.0] if q % 5 else [-1.0, 0.0]) for q in range(12)]
    tiles = spark.createDataFrame(asked, "query_id long, words array<string>, query_embedding array<float>")
    return rows, tiles.withColumn("tile", (F.col("query_id") % 3).cast("int"))


@pytest.mark.parametrize("least_parts", [1, 100])
def test_ties_of_many_parts_are_settled_by_chunk(spark, past_tiles_only, monkeypatch, least_parts):
    monkeypatch.setattr(tiled_scoring, "LEAST_PARTS", least_parts)
    rows, tiles = tied_rows(spark)
    want = dense(best_by_tiles(rows, tiles, 3, 7))
    assert dense(best_by_tiles(rows, tiles, 3, 7, 10)) == want != []
    assert len({(r[0], r[4]) for r in want}) < len(want) / 6


@pytest.mark.parametrize("cut", [3, 50])
def test_a_tile_keeps_no_more_than_twice_the_wanted_rows(spark, cut):
    rows, queries = random_part(400, 12, 3, copies=400)
    rows = rows.set_column(4 - 1, "embedding", pa.array([[1.0] * 8] * 400, pa.list_(pa.float32())))
    tile = tiled_scoring.TileBest(queries, cut, False)
    for at in range(0, 400, 10):
        part = tiled_scoring.in_chunk_order(rows.slice(at, 10))
        row, *found = tiled_scoring.best_of_part(part, tile.queries, cut, 10**6, False, tile.asked, tile.least)
        tile.add(part, row, *found)
        tile.merge()
        assert np.bincount(tile.query).max() <= 2 * cut
    whole = tiled_scoring._scorer(cut, 10**6, False)(rows, queries).to_pylist()
    key = lambda r: (r["query_id"], -r["cosine"], r["video_id"], r["chunk_index"])
    got = sorted((r for b in tile.batches() for r in b.to_pylist()), key=key)
    best = [r for i, r in enumerate(got) if i < cut or got[i - cut]["query_id"] != r["query_id"]]
    assert [key(r) for r in best] == sorted(key(r) for r in whole)


def test_bounds_past_tiles_move_no_pair_of_vectors(spark, past_tiles_only):
    """Pairs are scored where code and vector of a part are; no vector is shuffled for a pair."""
    rows, tiles = tied_rows(spark)
    folder = staging_folder(spark)
    coded = stage(quantised(rows), f"{folder}/coded")
    unique = rows.dropDuplicates(["video_id", "chunk_index"])
    got = best_by_bounds(coded.dropDuplicates(["video_id", "chunk_index"]), unique, tiles, 3, 7, folder, 10)
    plan = plan_of(got.best)
    assert "CartesianProduct" in plan and "CoGroup" not in plan and "SortMergeJoin" not in plan
    one = best_by_bounds(coded.dropDuplicates(["video_id", "chunk_index"]), unique, tiles, 3, 7, f"{folder}/one")
    assert "CartesianProduct" not in plan_of(one.best)
    assert dense(got.best) == dense(one.best) == dense(best_by_tiles(unique, tiles, 3, 7)) != []
    counts = lambda w: sorted(map(tuple, w.work.select("query_id", "n_matched").collect()))
    assert counts(got) == counts(one)
