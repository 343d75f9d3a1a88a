"""Headline timings: one JSON line.

The index is built once from the raw documents and timed part by part, then whole query batches run
on it. Every part is written out completely (to Spark's no-op sink or as a staged table).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_search.operators.batch_scoring import search_rows
from corpus_search.operators.chunking import split_documents
from corpus_search.operators.embedding import embed_chunks
from corpus_search.operators.ingest import classify_items, new_transcripts
from corpus_search.operators.knowledge import knowledge_base
from corpus_search.operators.lexical import build_bm25
from corpus_search.operators.prompts import user_prompts
from corpus_search.operators.spelling import prepare_queries, word_dictionary
from corpus_search.plans import derived as dv
from corpus_search.plans.search import search
from corpus_search.sources.staging import stage, staging_folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = staging_folder(spark)
    seconds: dict[str, float] = {}

    def timed(name: str, make, staged: bool = False) -> DataFrame:
        start = time.perf_counter()
        df = make()
        if staged:
            df = stage(df, f"{folder}/{name}")
        else:
            df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        return df

    spark.range(1000).select(F.sum("id")).collect()
    documents = timed("transcripts", lambda: dv.transcripts(spark, sf_dir), staged=True)
    timed("b2_windows", lambda: split_documents(documents, dv.INDEX))
    chunks = timed(
        "b11_chunk_table",
        lambda: embed_chunks(
            split_documents(documents, dv.INDEX), dv.EMBEDDER, dv.INDEX.embedding_width
        ),
        staged=True,
    )
    bm25 = timed("l7_bm25_build", lambda: build_bm25(chunks, folder), staged=True)
    knowledge = timed("k4_knowledge_base", lambda: knowledge_base(chunks, documents), staged=True)
    rows = timed("search_rows", lambda: search_rows(knowledge, bm25), staged=True)
    dictionary = timed("q3_dictionary", lambda: word_dictionary(documents), staged=True)
    prepared = timed(
        "q4_prepare_queries",
        lambda: prepare_queries(dv.queries(spark, sf_dir), dictionary),
        staged=True,
    )

    funnel = (prepared, knowledge, bm25, dv.SEARCH, dv.EMBEDDER, dv.RERANKER)
    results = timed("r12_search", lambda: search(*funnel, rows), staged=True)
    timed("r12_search_by_joins", lambda: search(*funnel))
    timed("p2_user_prompts", lambda: user_prompts(dv.queries(spark, sf_dir), results))

    def ingest() -> DataFrame:
        snippets = dv.snippets(spark, sf_dir)
        classified = classify_items(
            dv.items(spark, sf_dir), dv.known_transcripts(spark, sf_dir), snippets
        )
        return new_transcripts(classified, snippets)

    timed("i9_ingest", ingest)
    print(
        json.dumps(
            {
                "metric": "index build and batch search",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
