"""The registered queries: one or more for every operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_search.functions import templates
from corpus_search.functions import text as tx
from corpus_search.functions.vectors import dot, l2_normalise, require_width
from corpus_search.operators import (
    audit,
    batch_scoring,
    chunking,
    context,
    embedding,
    evaluation,
    ingest,
    knowledge,
    lexical,
    postings,
    prompts,
    pruned_ranking,
    quantised,
    reranking,
    retrieval,
    spelling,
    table_hashes,
    tiled_scoring,
)
from corpus_search.plans import derived as dv
from corpus_search.plans import search as search_plan
from corpus_search.settings import IndexSettings
from corpus_search.sources import snapshots
from corpus_search.sources.buckets import write_bucketed
from corpus_search.sources.listing import read_landed, read_listings
from corpus_search.sources.schemas import TRANSCRIPTS, empty_table
from corpus_search.sources.staging import stage, staging_folder
from corpus_search.sources.tables import read_parquet
from corpus_search.streaming.ingest_stream import run_ingest
from corpus_search.streaming.transcript_stream import run_transcripts

Query = Callable[[SparkSession, str], DataFrame]

EVERYTHING = 1_000_000_000
THRESHOLDS = [0.1, 0.3, 0.5, 0.7, 0.9, 0.99]


def r6(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), 6)


def _seconds(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


# --- sources and sinks ---------------------------------------------------------------------------


def parquet_scan(spark, d):
    return read_parquet(
        spark, f"{d}/documents.parquet", "doc_id", "source", "lang", "n_chars"
    ).filter(F.col("lang") == "en")


def listing_json(spark, d):
    folder = staging_folder(spark)
    dv.listings(spark, d).write.json(f"{folder}/listing")
    return read_listings(spark, f"{folder}/listing").select(
        "channel_id", "video_id", "published_at", "title", "kind"
    )


def listing_rejects(spark, d):
    """Listings of which one in four is cut short, one has a word in place of its items, and one has
    unreadable dates, with what is read of them and what is refused."""
    folder = staging_folder(spark)
    page = F.floor(F.col("items")[0]["id"]["videoId"].cast("bigint") / 50) % 4
    undated = F.transform(
        "items",
        lambda item: F.struct(
            item["id"].alias("id"),
            F.struct(F.lit("soon").alias("publishedAt"), item["snippet"]["title"].alias("title"))
            .alias("snippet"),
        ),
    )
    record = F.to_json(F.struct("channel_id", "items"))
    line = (
        F.when(page == 0, F.substring(record, F.lit(1), F.char_length(record) - 9))
        .when(page == 1, F.to_json(F.struct("channel_id", F.lit("none").alias("items"))))
        .when(page == 2, F.to_json(F.struct("channel_id", undated.alias("items"))))
        .otherwise(record)
    )
    dv.listings(spark, d).select(line.alias("value")).write.text(f"{folder}/landing")
    items, rejects = read_landed(spark, f"{folder}/landing")
    read = items.select("channel_id", F.lit("listed").alias("reason"))
    refused = rejects.select(
        F.when(F.col("reason") == "malformed_json", "")
        .otherwise(F.coalesce("channel_id", F.lit("")))
        .alias("channel_id"),
        "reason",
    )
    return read.unionByName(refused).groupBy("channel_id", "reason").agg(F.count("*").alias("n"))


def typed_empty(spark, d):
    first_run = snapshots.append_new(empty_table(spark, TRANSCRIPTS), dv.transcripts(spark, d))
    return first_run.select(
        "video_id", _seconds("creation_date"), "title", F.length("transcript").alias("n_chars")
    )


def append_chunks(spark, d):
    old = chunking.split_documents(dv.known_transcripts(spark, d), dv.INDEX)
    return snapshots.sorted_chunks(snapshots.append_new(old, dv.chunks(spark, d)))


def rebuild_bm25(spark, d):
    old = chunking.split_documents(dv.known_transcripts(spark, d), dv.INDEX)
    folder = staging_folder(spark)
    chunks = stage(snapshots.append_new(old, dv.chunks(spark, d)), f"{folder}/chunks")
    scores = lexical.build_bm25(chunks, folder)
    return scores.groupBy("token").agg(
        F.count("*").alias("n_chunks"), F.round(F.sum("score"), 4).alias("total_score")
    )


def append_bm25(spark, d):
    """The index after three appended versions, of which none reads or writes the others' postings."""
    scores = postings.current_scores(dv.grown_index(spark, d))
    return scores.groupBy("token").agg(
        F.count("*").alias("n_chunks"), F.round(F.sum("score"), 4).alias("total_score")
    )


def append_transcripts(spark, d):
    both = snapshots.append_new(dv.known_transcripts(spark, d), dv.transcripts(spark, d))
    return snapshots.sorted_transcripts(both).select(
        "video_id", _seconds("creation_date"), "title", "transcript"
    )


def _publish(spark, d, root):
    ix = dv.index(spark, d)
    return snapshots.publish(
        spark, root, {"transcripts": ix.transcripts, "chunks": ix.chunks}, {"bm25": ix.bm25}
    )


def atomic_publish(spark, d):
    root = f"{staging_folder(spark)}/tables"
    _publish(spark, d, root)
    counts = [
        snapshots.read_table(spark, root, name).agg(
            F.lit(name).alias("table_name"), F.count("*").alias("n_rows")
        )
        for name in ("transcripts", "chunks", "bm25")
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def publish_gates(spark, d):
    """The first run publishes version 1; adding nothing to the same index leaves it current."""
    root = f"{staging_folder(spark)}/tables"
    first = _publish(spark, d, root)
    stored = {name: snapshots.read_table(spark, root, name) for name in ("transcripts", "chunks")}
    ix = dv.index(spark, d)
    nothing = {
        "transcripts": ix.transcripts.join(
            stored["transcripts"].select("video_id"), "video_id", "left_anti"
        ),
        "chunks": ix.chunks.join(stored["chunks"].select("video_id"), "video_id", "left_anti"),
    }
    second = snapshots.publish(spark, root, nothing, {"bm25": ix.bm25})
    return snapshots.read_table(spark, root, "bm25").agg(
        F.count("*").alias("n_rows"),
        F.lit(first).alias("first_version"),
        F.lit(second).alias("second_version"),
    )


def _gaps(spark, d):
    """An index with gaps: toxic documents have no transcript, documents of low quality have no
    chunks, and the chunks of labelled documents have no scores."""
    labels = dv.labelled(spark, d)
    toxic = labels.filter("toxic = 1").select("video_id")
    poor = labels.filter("quality = 0").select("video_id")
    stored = dv.transcripts(spark, d).join(toxic, "video_id", "left_anti")
    chunks = dv.chunks(spark, d).join(poor, "video_id", "left_anti")
    # Tokens and frequencies are stored, so that no score is shuffled or sorted for its token.
    scores = lexical.build_bm25(chunks, staging_folder(spark))
    return stored, chunks, scores.join(labels.select("video_id"), "video_id", "left_anti")


def index_audit(spark, d):
    return audit.index_issues(*_gaps(spark, d)).fillna(0, ["chunk_index"])


def audit_by_hashes(spark, d):
    """The same gaps, found from stored keys and sums per bucket."""
    folder = staging_folder(spark)
    keys = stage(table_hashes.table_keys(*_gaps(spark, d)), f"{folder}/keys")
    hashes = stage(table_hashes.key_hashes(keys), f"{folder}/hashes")
    return table_hashes.issues_by_hashes(keys, hashes).fillna(0, ["chunk_index"])


# --- ingest --------------------------------------------------------------------------------------


def newest(spark, d):
    return ingest.newest_per_channel(dv.items(spark, d), 20)


def required_fields(spark, d):
    """Items titled by their conversation's first line, so most documents lack a title."""
    titles = dv.snippets(spark, d).filter("seq = 0").select("video_id", F.col("text").alias("t"))
    items = dv.items(spark, d).join(titles, "video_id", "left").withColumn("title", F.col("t"))
    return items.filter(ingest.has_required_fields()).select(
        "channel_id", "video_id", "published_at", "title"
    )


def not_ingested(spark, d):
    return ingest.not_yet_ingested(dv.items(spark, d), dv.known_transcripts(spark, d))


def snippets_joined(spark, d):
    return ingest.assemble_snippets(dv.snippets(spark, d))


def _classified(spark, d):
    return ingest.classify_items(
        dv.items(spark, d), dv.known_transcripts(spark, d), dv.snippets(spark, d)
    )


def outcome_of_items(spark, d):
    return _classified(spark, d).select("channel_id", "video_id", "outcome")


def timestamps(spark, d):
    """Dates of all documents in the three accepted spellings and one that is refused."""
    stamp = F.substring("published_at", 1, 19)
    spelling = (
        F.when(F.col("video_id").endswith("1"), F.concat(stamp, F.lit("+02:00")))
        .when(F.col("video_id").endswith("2"), F.concat(stamp, F.lit("-0530")))
        .when(F.col("video_id").endswith("3"), stamp)
        .otherwise(F.col("published_at"))
    )
    return dv.items(spark, d).select(
        "video_id",
        F.coalesce(ingest.parse_timestamp(spelling).cast("string"), F.lit("rejected")).alias(
            "creation_date"
        ),
    )


def whitespace(spark, d):
    """Web pages with every tag turned into a line break."""
    opened = F.translate("html", "<>", "\n\n")
    return dv.table(spark, d, "pages").select(
        "page_id", tx.collapse_whitespace(opened).alias("collapsed")
    )


def entities(spark, d):
    return dv.table(spark, d, "pages").select(
        "page_id", tx.decode_entities(F.col("html")).alias("decoded")
    )


def union_of_channels(spark, d):
    """New transcripts of two batches that overlap: all channels, and all channels again under
    other names."""
    items = dv.items(spark, d)
    again = items.withColumn("channel_id", F.concat(F.lit("again-"), "channel_id"))
    snippets = dv.snippets(spark, d)
    classified = ingest.classify_items(
        items.unionByName(again), dv.known_transcripts(spark, d), snippets
    )
    return ingest.new_transcripts(classified, snippets).select(
        "video_id", _seconds("creation_date"), "title", "transcript"
    )


def outcomes_per_channel(spark, d):
    return ingest.channel_outcomes(_classified(spark, d))


# --- chunks, context, embeddings -----------------------------------------------------------------


def truncated(spark, d):
    """At a limit of 100 tokens, so that it matters for the given documents."""
    settings = IndexSettings(max_document_tokens=100)
    return chunking.truncate_documents(dv.transcripts(spark, d), settings).select(
        "video_id", "transcript"
    )


def windows(spark, d):
    return dv.chunks(spark, d)


def windows_default_size(spark, d):
    """Windows of 512 tokens with 51 shared ones."""
    return chunking.split_documents(dv.transcripts(spark, d), IndexSettings())


def stripped_chunks(spark, d):
    return dv.chunks(spark, d).select(
        "video_id", "chunk_index", (tx.strip(F.col("chunk")) == F.col("chunk")).alias("is_stripped")
    )


def no_chunks(spark, d):
    """Documents that are blank once ASCII letters, full stops and commas are taken out."""
    rest = F.translate(F.lower("transcript"), "abcdefghijklmnopqrstuvwxyz.,", " " * 28)
    return chunking.documents_without_chunks(
        dv.transcripts(spark, d).withColumn("transcript", rest)
    )


def prompt_table(spark, d):
    return context.context_prompts(
        dv.transcripts(spark, d), dv.chunks(spark, d), dv.INDEX
    ).select("video_id", "chunk_index", F.md5("prompt").alias("prompt_md5"))


def contextual_chunks(spark, d):
    return context.add_context(dv.chunks(spark, d), dv.completions(spark, d))


def fallback_rate(spark, d):
    rates = context.fallback_rates(contextual_chunks(spark, d))
    return rates.withColumn("fallback_rate", r6("fallback_rate"))


def task_prefix(spark, d):
    return dv.chunks(spark, d).select(
        "video_id",
        "chunk_index",
        embedding.with_document_prefix(F.col("chunk")).alias("document_text"),
        embedding.with_query_prefix(F.col("chunk")).alias("query_text"),
    )


def _components(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("position", "value")).select(
        *keys, "position", r6("value").alias("value")
    )


def embedded(spark, d):
    chunks = embedding.embed_chunks(dv.chunks(spark, d), dv.EMBEDDER, dv.INDEX.embedding_width)
    return _components(chunks, "embedding", "video_id", "chunk_index").filter("value <> 0")


def normalised(spark, d):
    """The given vectors, stretched by their label, then brought back to unit length."""
    stretched = dv.table(spark, d, "embeddings").select(
        "vec_id",
        F.transform(
            "embedding", lambda x: (x.cast("double") * (F.col("label") + 2)).cast("float")
        ).alias("embedding"),
    )
    return _components(
        stretched.withColumn("embedding", l2_normalise(F.col("embedding"))), "embedding", "vec_id"
    )


def chunk_records(spark, d):
    chunks = embedding.embed_chunks(dv.chunks(spark, d), dv.EMBEDDER, dv.INDEX.embedding_width)
    return chunks.select(
        "video_id", "chunk_index", "chunk", F.size("embedding").alias("embedding_width")
    )


def ordered_chunks(spark, d):
    return snapshots.sorted_chunks(dv.chunks(spark, d)).select(
        "video_id", "chunk_index", F.length("chunk").alias("n_chars")
    )


def vector_width(spark, d):
    return dv.table(spark, d, "embeddings").select(
        "vec_id", F.size(require_width(F.col("embedding"), 64)).alias("width")
    )


# --- lexical index -------------------------------------------------------------------------------


def stop_words(spark, d):
    return lexical.stop_word_counts(dv.chunks(spark, d))


def tokens(spark, d):
    return lexical.chunk_tokens(dv.chunks(spark, d)).select(
        "video_id", "chunk_index", F.array_join("tokens", " ").alias("tokens")
    )


def chunk_lengths(spark, d):
    return lexical.chunk_tokens(dv.chunks(spark, d)).select("video_id", "chunk_index", "n_tokens")


def statistics(spark, d):
    found = lexical.corpus_statistics(lexical.chunk_tokens(dv.chunks(spark, d)))
    return found.withColumn("avg_n_tokens", r6("avg_n_tokens"))


def _terms(spark, d):
    return lexical.term_frequencies(lexical.chunk_tokens(dv.chunks(spark, d)))


def idf(spark, d):
    n_chunks = lexical.corpus_statistics(lexical.chunk_tokens(dv.chunks(spark, d)))
    frequencies = lexical.document_frequencies(_terms(spark, d))
    found = lexical.inverse_document_frequencies(
        frequencies, n_chunks.select("n_chunks").scalar()
    )
    return found.withColumn("idf", r6("idf"))


def bm25(spark, d):
    return lexical.bm25_scores(dv.chunks(spark, d)).withColumn("score", r6("score"))


def bm25_of_versions(spark, d):
    return postings.current_scores(dv.grown_index(spark, d)).withColumn("score", r6("score"))


# --- knowledge base ------------------------------------------------------------------------------


def counts(spark, d):
    return knowledge.chunk_counts(dv.chunks(spark, d)).select("video_id", "chunk_count")


def titled_chunks(spark, d):
    """Toxic documents are unknown here, so their chunks vanish."""
    toxic = dv.labelled(spark, d).filter("toxic = 1").select("video_id")
    known = dv.transcripts(spark, d).join(toxic, "video_id", "left_anti")
    ix = dv.index(spark, d)
    return knowledge.knowledge_base(ix.chunks, known).select("video_id", "chunk_index", "title")


def marks(spark, d):
    ix = dv.index(spark, d)
    return knowledge.knowledge_base(ix.chunks, ix.transcripts).select(
        "video_id", "chunk_index", "start", "end"
    )


def knowledge_rows(spark, d):
    ix = dv.index(spark, d)
    return knowledge.ordered(knowledge.knowledge_base(ix.chunks, ix.transcripts)).select(
        "video_id", "chunk_index", "title", "start", "end", "chunk",
        F.size("embedding").alias("embedding_width"),
    )


def _bucketed(spark, d):
    folder, buckets = staging_folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    ix = dv.index(spark, d)
    return [
        write_bucketed(df, f"{folder}/{name}", buckets)
        for name, df in (("chunks", ix.chunks), ("transcripts", ix.transcripts))
    ]


def knowledge_rows_co_bucketed(spark, d):
    """The knowledge base of tables that share their buckets."""
    return knowledge.co_bucketed_knowledge(*_bucketed(spark, d)).select(
        "video_id", "chunk_index", "title", "start", "end", "chunk",
        F.size("embedding").alias("embedding_width"),
    )


def append_chunks_co_bucketed(spark, d):
    """Chunks of new documents after those of known ones, told apart bucket by bucket."""
    folder, buckets = staging_folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    old = chunking.split_documents(dv.known_transcripts(spark, d), dv.INDEX)
    old = write_bucketed(old, f"{folder}/old", buckets)
    new = write_bucketed(dv.chunks(spark, d), f"{folder}/new", buckets)
    return old.unionByName(new.join(old.select("video_id").hint("merge"), "video_id", "left_anti"))


# --- queries and retrieval -----------------------------------------------------------------------


def without_punctuation(spark, d):
    return dv.queries(spark, d).select(
        "query_id", tx.without_query_punctuation(F.col("query")).alias("query")
    )


def split_queries(spark, d):
    return dv.queries(spark, d).select(
        "query_id", F.posexplode(tx.query_words(F.col("query"))).alias("position", "word")
    )


def spelling_corrections(spark, d):
    """All words of all queries, and the same words with their first two characters swapped."""
    words = dv.queries(spark, d).select(
        F.explode(tx.query_words(F.col("query"))).alias("word")
    )
    swapped = words.select(
        F.concat(
            F.substring("word", 2, 1), F.substring("word", 1, 1), F.substring("word", 3, EVERYTHING)
        ).alias("word")
    )
    return spelling.corrections(words.unionByName(swapped), dv.index(spark, d).dictionary)


def spelling_with_stored_deletions(spark, d):
    """The same words against the dictionary and its deletions as three versions have stored them."""
    words = dv.queries(spark, d).select(F.explode(tx.query_words(F.col("query"))).alias("word"))
    swapped = words.select(
        F.concat(
            F.substring("word", 2, 1), F.substring("word", 1, 1), F.substring("word", 3, EVERYTHING)
        ).alias("word")
    )
    root = dv.grown_root(spark, d)
    return spelling.corrections(
        words.unionByName(swapped),
        spelling.summed(snapshots.read_table(spark, root, "words")),
        snapshots.read_table(spark, root, "variants"),
    )


def rejoined_queries(spark, d):
    prepared = spelling.prepare_queries(dv.queries(spark, d), dv.index(spark, d).dictionary)
    return prepared.select("query_id", "query", "corrected")


def membership(spark, d):
    ix = dv.index(spark, d)
    found = ix.bm25.join(retrieval.query_tokens(ix.prepared), "token")
    return found.select("query_id", "video_id", "chunk_index", "token")


def lexical_scores(spark, d):
    ix = dv.index(spark, d)
    found = retrieval.lexical_candidates(ix.bm25, retrieval.query_tokens(ix.prepared))
    return found.withColumn("lexical_score", r6("lexical_score"))


def lexical_scores_of_postings(spark, d):
    found = postings.current_candidates(
        dv.grown_index(spark, d), retrieval.query_tokens(dv.index(spark, d).prepared)
    )
    return found.withColumn("lexical_score", r6("lexical_score"))


def _pruned(spark, d, cut):
    tokens = retrieval.query_tokens(dv.index(spark, d).prepared)
    return pruned_ranking.best_lexical(
        dv.grown_index(spark, d), tokens, cut, staging_folder(spark)
    )


def lexical_top_pruned(spark, d):
    return _pruned(spark, d, 250).best.withColumn("lexical_score", r6("lexical_score"))


def candidate_passages(spark, d):
    ix = dv.index(spark, d)
    texts = ix.knowledge.withColumn("n", F.length("chunk"))
    found = retrieval.lexical_passages(
        ix.bm25, retrieval.query_tokens(ix.prepared), texts, "title", "start", "end", "n"
    )
    return found.select("query_id", "video_id", "chunk_index", "title", "start", "end", "n")


def cosine_of_vectors(spark, d):
    """Every given vector against the mean vector of each label."""
    vectors = dv.table(spark, d, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("position", "x"))
        .groupBy("label", "position")
        .agg(F.avg(F.round(F.col("x").cast("double"), 6)).alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("position", "x"))).alias("sorted"))
        .select("label", l2_normalise(F.col("sorted.x")).alias("mean"))
    )
    return vectors.join(means, "label").select(
        "vec_id", "label", r6(dot(F.col("embedding"), F.col("mean"))).alias("cosine")
    )


def _similarities(spark, d):
    ix = dv.index(spark, d)
    vectors = embedding.embed_queries(ix.prepared, dv.EMBEDDER)
    return retrieval.lexical_similarities(
        ix.bm25, retrieval.query_tokens(ix.prepared), ix.knowledge, vectors
    )


def similarities(spark, d):
    return _similarities(spark, d).select(
        "query_id", "video_id", "chunk_index", r6("cosine").alias("cosine")
    )


def positive(spark, d):
    return similarities(spark, d).filter(F.col("cosine") > 0)


def _dense_columns(top: DataFrame) -> DataFrame:
    return top.select(
        "query_id", "video_id", "chunk_index", "dense_rank", r6("cosine").alias("cosine"),
        r6("lexical_score").alias("lexical_score"),
    )


def dense_top(spark, d):
    ix = dv.index(spark, d)
    return _dense_columns(
        search_plan.joined_candidates(ix.prepared, ix.knowledge, ix.bm25, dv.SEARCH, dv.EMBEDDER)
    )


def dense_top_in_place(spark, d):
    ix = dv.index(spark, d)
    vectors = embedding.embed_queries(ix.prepared, dv.EMBEDDER)
    batch = batch_scoring.query_batch(ix.prepared, vectors)
    return _dense_columns(batch_scoring.best_in_place(ix.asked_rows, batch, dv.SEARCH.dense_cut))


def dense_top_by_tiles(spark, d):
    """Every document's title as a query, against all chunks."""
    asked = dv.titles_as_queries(spark, d)
    vectors = embedding.embed_queries(asked, dv.EMBEDDER)
    tiles, n_tiles = tiled_scoring.query_tiles(asked, vectors)
    rows = dv.index(spark, d).rows
    return _dense_columns(
        tiled_scoring.best_by_tiles(rows, tiles, n_tiles, dv.SEARCH.dense_cut)
    )


def dense_top_by_bounds(spark, d):
    """The same titles; vectors of eight bits rule out what can't be among the best."""
    asked = dv.titles_as_queries(spark, d)
    tiles, n_tiles = tiled_scoring.query_tiles(asked, embedding.embed_queries(asked, dv.EMBEDDER))
    rows, folder = dv.index(spark, d).rows, staging_folder(spark)
    coded = stage(quantised.quantised(rows), f"{folder}/coded")
    tiles = stage(tiles, f"{folder}/tiles")
    return _dense_columns(
        quantised.best_by_bounds(coded, rows, tiles, n_tiles, dv.SEARCH.dense_cut, folder).best
    )


def search_by_tiles(spark, d):
    """The search with its queries in tiles of 16, for as many as there may be."""
    ix = dv.index(spark, d)
    knowledge = ix.knowledge
    dense = search_plan.tiled_candidates(ix.prepared, ix.asked_rows, dv.SEARCH, dv.EMBEDDER, 16)
    scored = retrieval.with_relevance(
        dense, knowledge, ix.prepared, dv.RERANKER, dv.SEARCH.dense_cut * ix.prepared.count()
    )
    return retrieval.result_columns(
        retrieval.top_results(scored, dv.SEARCH), dv.SEARCH.url_prefix
    )


def search_by_joins(spark, d):
    ix = dv.index(spark, d)
    return search_plan.search(
        ix.prepared, ix.knowledge, ix.bm25, dv.SEARCH, dv.EMBEDDER, dv.RERANKER
    )


def titled_passages(spark, d):
    return dv.index(spark, d).knowledge.select(
        "video_id",
        "chunk_index",
        retrieval.titled_passage(F.col("title"), F.col("chunk")).alias("titled_chunk"),
    )


def rerank_scores(spark, d):
    return dv.index(spark, d).scored().select(
        "query_id", "video_id", "chunk_index", r6("relevance").alias("relevance")
    )


def threshold(spark, d):
    kept = retrieval.above_threshold(dv.index(spark, d).scored(), dv.SEARCH.threshold)
    return kept.select("query_id", "video_id", "chunk_index", r6("relevance").alias("relevance"))


def _top(spark, d):
    return retrieval.top_results(dv.index(spark, d).scored(), dv.SEARCH)


def top_k(spark, d):
    return _top(spark, d).select("query_id", "rank", "video_id", "chunk_index")


def result_columns(spark, d):
    return retrieval.result_columns(_top(spark, d), dv.SEARCH.url_prefix)


def search(spark, d):
    ix = dv.index(spark, d)
    return search_plan.search(
        ix.prepared, ix.knowledge, ix.bm25, dv.SEARCH, dv.EMBEDDER, dv.RERANKER, ix.asked_rows
    )


# --- prompts and answers -------------------------------------------------------------------------


def context_blocks(spark, d):
    return prompts.context_blocks(search(spark, d))


def user_prompts(spark, d):
    return prompts.user_prompts(dv.queries(spark, d), search(spark, d))


def system_prompts(spark, d):
    return prompts.system_prompts(dv.queries(spark, d))


def template_contract(spark, d):
    """Doubled braces are literal, and braces inside the inserted text stay as they are."""
    filled = templates.fill("{{{query}}}", query=F.concat(F.lit("{query} "), F.col("query")))
    return dv.queries(spark, d).select("query_id", filled.alias("prompt"))


def merged_answers(spark, d):
    return prompts.answers(dv.queries(spark, d), dv.answers(spark, d))


def context_stripped(spark, d):
    chunks = contextual_chunks(spark, d)
    return chunks.select(
        "video_id", "chunk_index", prompts.without_context(F.col("chunk")).alias("last_line")
    )


def search_links(spark, d):
    return prompts.search_links(dv.queries(spark, d), search(spark, d))


# --- evaluation ----------------------------------------------------------------------------------


def recall(spark, d):
    ranked = retrieval.best_per_query(dv.index(spark, d).scored(), "relevance", 250)
    found = evaluation.recall_at(ranked, dv.planted(spark, d), [1, 3, 10])
    return found.withColumn("recall", r6("recall")).withColumn("hit_rate", r6("hit_rate"))


def sweep(spark, d):
    found = evaluation.threshold_sweep(
        dv.index(spark, d).scored(), dv.planted(spark, d), THRESHOLDS
    )
    return found.withColumn("recall", r6("recall"))


def fusion(spark, d):
    ix = dv.index(spark, d)
    fused = evaluation.lexical_fusion(
        ix.bm25,
        retrieval.query_tokens(ix.prepared),
        ix.knowledge,
        embedding.embed_queries(ix.prepared, dv.EMBEDDER),
        250,
    )
    return fused.select("query_id", "video_id", "chunk_index", r6("fused_score").alias("score"))


def fusion_pruned(spark, d):
    """The same fusion, with both rankings cut where they are found."""
    ix = dv.index(spark, d)
    tiles, n_tiles = tiled_scoring.query_tiles(
        ix.prepared, embedding.embed_queries(ix.prepared, dv.EMBEDDER)
    )
    dense = tiled_scoring.best_by_tiles(ix.asked_rows, tiles, n_tiles, 250, positive=False)
    fused = evaluation.fused_rankings(_pruned(spark, d, 250).best, dense, 250)
    return fused.select("query_id", "video_id", "chunk_index", r6("fused_score").alias("score"))


# --- model surfaces, streaming -------------------------------------------------------------------


def model_embeddings(spark, d):
    """Letter counts as a stand-in for a trained embedder, over all transcripts."""

    def load():
        letters = "abcdefgh"
        return lambda texts: np.array([[t.count(c) for c in letters] for t in texts], dtype=float)

    embed = embedding.model_embedder(load)
    vectors = dv.transcripts(spark, d).select(
        "video_id", embed(F.col("transcript")).alias("embedding")
    )
    return _components(vectors, "embedding", "video_id")


def model_relevance(spark, d):
    """Likeness of length as a stand-in for a trained reranker: titles against transcripts."""

    def load():
        return lambda pairs: np.array([1.0 / (1.0 + abs(len(a) - len(b))) for a, b in pairs])

    score = reranking.model_reranker(load)
    return dv.transcripts(spark, d).select(
        "video_id", r6(score(F.col("title"), F.col("transcript"))).alias("relevance")
    )


def completion_merge(spark, d):
    return contextual_chunks(spark, d).select("video_id", "chunk_index", "chunk")


def streamed_ingest(spark, d):
    """Two runs over the same landed listings; the second finds nothing to add."""
    folder = staging_folder(spark)
    dv.listings(spark, d).write.json(f"{folder}/landing")
    dv.snippets(spark, d).write.parquet(f"{folder}/snippets")
    for checkpoint in ("first", "again"):
        run_ingest(
            spark,
            f"{folder}/landing",
            f"{folder}/snippets",
            f"{folder}/tables",
            f"{folder}/checkpoint-{checkpoint}",
            dv.INDEX,
            dv.EMBEDDER,
            max_listed=EVERYTHING,
        )
    return snapshots.read_table(spark, f"{folder}/tables", "transcripts").select(
        "video_id", _seconds("creation_date"), "title", "transcript"
    )


def transcript_stream(spark, d):
    """All listings and snippets in three landings: odd snippets with one half of the listings, the
    other half, even snippets. Nothing is complete until an hour has passed; a fourth run then
    publishes all of them."""
    folder = staging_folder(spark)
    listings = dv.listings(spark, d)
    snippets = dv.snippets(spark, d).withColumn("landed_at", F.lit(None).cast("timestamp"))
    half = F.pmod(F.xxhash64(F.col("items")[0]["id"]["videoId"]), F.lit(2)) == 0
    odd = F.col("seq") % 2 == 1
    landings = [
        (listings.filter(half), snippets.filter(odd)),
        (listings.filter(~half), snippets.limit(0)),
        (listings.limit(0), snippets.filter(~odd)),
        (listings.limit(0), snippets.limit(0)),
    ]
    clock = datetime(2024, 1, 1, tzinfo=timezone.utc)
    for minutes, (listed, said) in zip((0, 10, 20, 600), landings, strict=True):
        listed.write.mode("append").json(f"{folder}/listings")
        said.write.mode("append").parquet(f"{folder}/snippets")
        run_transcripts(
            spark,
            f"{folder}/listings",
            f"{folder}/snippets",
            f"{folder}/tables",
            f"{folder}/checkpoint",
            dv.INDEX,
            dv.EMBEDDER,
            clock + timedelta(minutes=minutes),
            quiet_seconds=3600,
        )
    return snapshots.read_table(spark, f"{folder}/tables", "transcripts").select(
        "video_id", _seconds("creation_date"), "title", "transcript"
    )


QUERIES: dict[str, Query] = {
    "a1_parquet_scan": parquet_scan,
    "a2_listing_json": listing_json,
    "a2_listing_rejects": listing_rejects,
    "a3_typed_empty_table": typed_empty,
    "a4_append_chunks": append_chunks,
    "a4_append_chunks_co_bucketed": append_chunks_co_bucketed,
    "a5_rebuild_bm25": rebuild_bm25,
    "a5_append_bm25": append_bm25,
    "a6_append_transcripts": append_transcripts,
    "a7_atomic_publish": atomic_publish,
    "a8_publish_gates": publish_gates,
    "a9_index_audit": index_audit,
    "a9_audit_by_hashes": audit_by_hashes,
    "i1_newest_per_channel": newest,
    "i2_required_fields": required_fields,
    "i3_already_ingested": not_ingested,
    "i4_snippet_assembly": snippets_joined,
    "i5_item_outcomes": outcome_of_items,
    "i6_timestamp_parse": timestamps,
    "i7_whitespace_collapse": whitespace,
    "i8_entity_decode": entities,
    "i9_union_of_channels": union_of_channels,
    "i10_channel_outcomes": outcomes_per_channel,
    "b1_truncate_documents": truncated,
    "b2_windows": windows,
    "b2_windows_default_size": windows_default_size,
    "b3_chunk_strip": stripped_chunks,
    "b4_documents_without_chunks": no_chunks,
    "b5_context_prompts": prompt_table,
    "b6_context_merge": contextual_chunks,
    "b7_fallback_rate": fallback_rate,
    "b8_task_prefix": task_prefix,
    "b9_chunk_embedding": embedded,
    "b10_l2_normalise": normalised,
    "b11_chunk_record": chunk_records,
    "b12_ordered_chunks": ordered_chunks,
    "b13_vector_width": vector_width,
    "l1_stop_words": stop_words,
    "l2_tokens": tokens,
    "l3_chunk_length": chunk_lengths,
    "l4_corpus_statistics": statistics,
    "l5_term_frequency": _terms,
    "l6_idf": idf,
    "l7_bm25_scores": bm25,
    "l7_bm25_of_versions": bm25_of_versions,
    "k1_chunk_count": counts,
    "k2_title_join": titled_chunks,
    "k3_marks": marks,
    "k4_knowledge_base": knowledge_rows,
    "k4_knowledge_base_co_bucketed": knowledge_rows_co_bucketed,
    "q1_query_punctuation": without_punctuation,
    "q2_query_words": split_queries,
    "q3_spelling": spelling_corrections,
    "q3_spelling_stored": spelling_with_stored_deletions,
    "q4_corrected_query": rejoined_queries,
    "r1_token_membership": membership,
    "r2_lexical_score": lexical_scores,
    "r2_lexical_score_of_postings": lexical_scores_of_postings,
    "r2_lexical_top_pruned": lexical_top_pruned,
    "r3_passages": candidate_passages,
    "r4_cosine_of_vectors": cosine_of_vectors,
    "r4_cosine_similarity": similarities,
    "r5_positive_similarity": positive,
    "r6_dense_top": dense_top,
    "r6_dense_top_in_place": dense_top_in_place,
    "r6_dense_top_by_tiles": dense_top_by_tiles,
    "r6_dense_top_by_bounds": dense_top_by_bounds,
    "r7_titled_passage": titled_passages,
    "r8_rerank_score": rerank_scores,
    "r9_relevance_threshold": threshold,
    "r10_top_k": top_k,
    "r11_result_columns": result_columns,
    "r12_search": search,
    "r12_search_by_joins": search_by_joins,
    "r12_search_by_tiles": search_by_tiles,
    "p1_context_blocks": context_blocks,
    "p2_user_prompts": user_prompts,
    "p3_system_prompts": system_prompts,
    "p4_template_contract": template_contract,
    "p5_answers": merged_answers,
    "p6_context_stripped": context_stripped,
    "p7_search_links": search_links,
    "e1_recall": recall,
    "e2_threshold_sweep": sweep,
    "e3_rank_fusion": fusion,
    "e3_rank_fusion_pruned": fusion_pruned,
    "u1_model_embedder": model_embeddings,
    "u2_model_reranker": model_relevance,
    "u3_completion_merge": completion_merge,
    "s1_streamed_ingest": streamed_ingest,
    "s1_transcript_stream": transcript_stream,
}
