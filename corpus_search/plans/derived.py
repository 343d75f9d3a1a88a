"""The inputs of the registered queries, derived from the given tables.

Listings, transcripts and chunks come from `documents`, snippets from `conversations`, queries from
`benchmark`, vectors from `embeddings`, and the completions of a language model are stood in for by
`labels` and `documents`. Whole tables and whole texts are used throughout.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_search.functions.text import clean, document_words, query_words
from corpus_search.operators.batch_scoring import fits_batch, search_rows
from corpus_search.operators.chunking import split_documents
from corpus_search.operators.embedding import embed_chunks, hashed_embedder
from corpus_search.operators.knowledge import knowledge_base
from corpus_search.operators.lexical import build_bm25
from corpus_search.operators.postings import LexicalIndex
from corpus_search.operators.reranking import overlap_reranker
from corpus_search.operators.retrieval import query_tokens
from corpus_search.operators.spelling import prepare_queries, word_dictionary
from corpus_search.plans.build import append_documents, open_lexical
from corpus_search.plans.search import open_knowledge, open_rows, scored_candidates
from corpus_search.settings import IndexSettings, SearchSettings
from corpus_search.sources.staging import stage, staging_folder
from corpus_search.sources.tables import read_parquet, spread, state_of

INDEX = IndexSettings(chunk_size=64, embedding_width=64)
SEARCH = SearchSettings()
EMBEDDER = hashed_embedder(INDEX.embedding_width)
RERANKER = overlap_reranker()

# 2024-01-01 00:00:00 UTC; documents are one minute apart.
FIRST_SECOND = 1_704_067_200
SHINGLE = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def _first_sentence() -> F.Column:
    return F.regexp_extract("text", "^[^.\n]*", 0)


def _created() -> F.Column:
    return F.timestamp_seconds(F.lit(FIRST_SECOND) + F.col("doc_id") * 60)


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("string").alias("video_id"),
        _created().alias("creation_date"),
        clean(_first_sentence()).alias("title"),
        clean(F.col("text")).alias("transcript"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("channel_id"),
        F.col("doc_id").cast("string").alias("video_id"),
        F.date_format(_created(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        _first_sentence().alias("title"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel listings with pages of at most 50 consecutive documents."""
    item = F.struct(
        F.struct(F.lit("video").alias("kind"), F.col("video_id").alias("videoId")).alias("id"),
        F.struct(F.col("published_at").alias("publishedAt"), "title").alias("snippet"),
    )
    return (
        items(spark, sf_dir)
        .groupBy("channel_id", F.floor(F.col("video_id").cast("bigint") / 50).alias("page"))
        .agg(F.collect_list(item).alias("items"))
        .select("channel_id", "items")
    )


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("seq"), "text"
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("video_id"), "quality", "toxic"
    )


def known_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of the labelled documents, as if they were ingested before."""
    return transcripts(spark, sf_dir).join(
        labelled(spark, sf_dir).select("video_id"), "video_id", "left_semi"
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(transcripts(spark, sf_dir), INDEX)


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts for the chunks of labelled documents: cut off for toxic ones, empty for those of low
    quality, the title for the others."""
    titles = transcripts(spark, sf_dir).join(labelled(spark, sf_dir), "video_id")
    return (
        chunks(spark, sf_dir)
        .select("video_id", "chunk_index")
        .join(titles, "video_id")
        .select(
            "video_id",
            "chunk_index",
            F.when(F.col("toxic") == 1, "length").otherwise("stop").alias("finish_reason"),
            F.when(F.col("quality") == 0, "").otherwise(F.col("title")).alias("content"),
        )
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to the queries whose id is a labelled document: that document's title."""
    return (
        transcripts(spark, sf_dir)
        .join(labelled(spark, sf_dir), "video_id")
        .select(
            F.col("video_id").cast("bigint").alias("query_id"),
            F.when(F.col("toxic") == 1, "length").otherwise("stop").alias("finish_reason"),
            F.when(F.col("quality") == 0, "").otherwise(F.col("title")).alias("content"),
        )
    )


def titles_as_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles of all documents as prepared queries: as many as there are documents. All their
    words are in the corpus, so none is corrected."""
    words = query_words(F.col("title"))
    return transcripts(spark, sf_dir).select(
        F.col("video_id").cast("bigint").alias("query_id"),
        F.col("title").alias("query"),
        F.array_join(words, " ").alias("corrected"),
        words.alias("words"),
    )


def holders(queries: DataFrame, transcripts: DataFrame) -> DataFrame:
    """query_id, video_id of the documents that hold the whole text of a query. A blank query is
    held by none.

    All words of a held query but its first and last are whole words of the document, and those two
    end and begin words of it. So documents meet queries of eight words and more by runs of six
    words, and shorter ones by a word that holds the query's longest word, found over the corpus's
    different words by a run of up to three characters. The comparison of the texts decides.

    The words and the pairs that meet are written first: their size is known then, and while they are
    small neither the corpus's words nor its texts are shuffled to meet them.
    """
    folder = staging_folder(queries.sparkSession)
    wanted = queries.select("query_id", "query", document_words(F.col("query")).alias("asked"))
    words = transcripts.select(
        "video_id", "transcript", document_words(F.col("transcript")).alias("words")
    )
    runs = F.transform(
        F.sequence(F.lit(1), F.size("words") - (SHINGLE - 1)),
        lambda at: F.array_join(F.slice("words", at, SHINGLE), " "),
    )
    shingles = words.select(
        "video_id",
        F.explode(F.array_distinct(F.when(F.size("words") >= SHINGLE, runs))).alias("shingle"),
    )
    long = wanted.filter(F.size("asked") >= SHINGLE + 2).select(
        "query_id", F.array_join(F.slice("asked", 2, SHINGLE), " ").alias("shingle")
    )
    pairs = shingles.join(long, "shingle").select("query_id", "video_id")

    of = words.select("video_id", F.explode(F.array_distinct("words")).alias("word"))
    longest = F.array_max(
        F.transform("asked", lambda w: F.struct(F.char_length(w).alias("n"), w.alias("part")))
    )
    short = (
        wanted.filter(F.size("asked").between(1, SHINGLE + 1))
        .select("query_id", longest.alias("longest"))
        .select("query_id", "longest.part", F.substring("longest.part", 1, 3).alias("gram"))
    )
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.char_length("word")),
            lambda at: F.transform(
                F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring(F.col("word"), at, n)
            ),
        )
    )
    if not short.isEmpty():
        met = (
            of.select("word")
            .distinct()
            .select("word", F.explode(F.array_distinct(grams)).alias("gram"))
            .join(short, "gram")
            .filter(F.contains("word", "part"))
            .select("query_id", "word")
            .distinct()
        )
        by_words = of.join(stage(met, f"{folder}/met"), "word").select("query_id", "video_id")
        pairs = pairs.unionByName(by_words)
    return (
        stage(pairs.distinct(), f"{folder}/pairs")
        .join(transcripts.select("video_id", "transcript"), "video_id")
        .join(wanted.select("query_id", "query"), "query_id")
        .filter(F.contains("transcript", "query"))
        .select("query_id", "video_id")
        .distinct()
    )


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holders(queries(spark, sf_dir), index(spark, sf_dir).transcripts)


class Index:
    """Stored tables of one data set, and its prepared queries. A table is built when it is first
    read, so a query writes no table that it has no use for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.folder = spark, sf_dir, staging_folder(spark)

    @cached_property
    def transcripts(self) -> DataFrame:
        return stage(transcripts(self.spark, self.sf_dir), f"{self.folder}/transcripts")

    @cached_property
    def chunks(self) -> DataFrame:
        encoded = embed_chunks(
            split_documents(self.transcripts, INDEX), EMBEDDER, INDEX.embedding_width
        )
        return stage(encoded, f"{self.folder}/chunks")

    @cached_property
    def scores(self) -> DataFrame:
        """`bm25`, computed when it is read; its tokens and frequencies are stored."""
        # Scores need no vectors, so the chunk table is read only if another table has needed it.
        chunks = vars(self).get("chunks")
        if chunks is None:
            chunks = split_documents(self.transcripts, INDEX)
        return build_bm25(chunks, self.folder, INDEX.k1, INDEX.b)

    @cached_property
    def bm25(self) -> DataFrame:
        return stage(self.scores, f"{self.folder}/bm25")

    @cached_property
    def knowledge(self) -> DataFrame:
        return open_knowledge(self.transcripts, self.chunks, self.folder)

    @cached_property
    def rows(self) -> DataFrame:
        return open_rows(self.knowledge, self.bm25, self.folder)

    @cached_property
    def asked_rows(self) -> DataFrame:
        """`rows` as far as the prepared queries need them: a batch of queries meets only the chunks
        with one of its tokens, and of those only its tokens. More queries meet whole rows. Rows have no
        titles and texts, so those aren't gathered for them, and scores that are not stored yet are
        computed for the asked tokens only."""
        if "rows" in vars(self) or not fits_batch(self.prepared):
            return self.rows
        asked = F.broadcast(query_tokens(self.prepared).select("token").distinct())
        knowledge = vars(self).get("knowledge")
        if knowledge is None:
            knowledge = knowledge_base(self.chunks, self.transcripts)
        scores = vars(self).get("bm25", self.scores)
        return search_rows(knowledge, scores.join(asked, "token", "left_semi"))

    @cached_property
    def dictionary(self) -> DataFrame:
        # Words are read once, so texts aren't stored for them.
        texts = vars(self).get("transcripts")
        if texts is None:
            texts = transcripts(self.spark, self.sf_dir)
        return stage(word_dictionary(texts), f"{self.folder}/dictionary")

    @cached_property
    def prepared(self) -> DataFrame:
        return stage(
            prepare_queries(queries(self.spark, self.sf_dir), self.dictionary),
            f"{self.folder}/prepared",
        )

    def scored(self) -> DataFrame:
        return scored_candidates(
            self.prepared, self.knowledge, self.bm25, SEARCH, EMBEDDER, RERANKER, self.asked_rows
        )


def publish_versions(spark: SparkSession, sf_dir: str) -> str:
    """The root of an index to which all documents were added in three versions. A version's documents
    are written when they are appended."""
    folder = staging_folder(spark)
    documents = transcripts(spark, sf_dir)
    root = f"{folder}/tables"
    for version in range(3):
        part = documents.filter(F.crc32("video_id") % 3 == version)
        chunks = embed_chunks(split_documents(part, INDEX), EMBEDDER, INDEX.embedding_width)
        append_documents(spark, root, part, chunks, f"{folder}/{version}")
    return root


_kept: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build):
    """Built once per application and state of the data set's files."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    state = state_of(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet")
    if key not in _kept or _kept[key][0] != state:
        _kept[key] = (state, build(spark, sf_dir))
    return _kept[key][1]


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of a data set as the nightly run would build it."""
    return _once(spark, sf_dir, "index", Index)


def grown_root(spark: SparkSession, sf_dir: str) -> str:
    """Where the same documents were published in three versions."""
    return _once(spark, sf_dir, "versions", publish_versions)


def grown_index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """The lexical index of the three versions."""
    return open_lexical(spark, grown_root(spark, sf_dir))
