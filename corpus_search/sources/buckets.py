"""Stored tables that share their buckets, so that joins on the document need no exchange.

A version's chunks, transcripts and postings by document are written into the same number of
buckets by `video_id`, sorted within them. Joins and groupings by document then read bucket by
bucket: nothing is shuffled or sorted, whatever the size of the tables. Spark knows buckets from its
catalog only, so a folder is declared as an external table there; the catalog holds no data, and a
new session declares the folder again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "video_id"


def declare(spark: SparkSession, folder: str, schema: str, buckets: int) -> DataFrame:
    """The bucketed table that lies in a folder."""
    name = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet "
        f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{folder}'"
    )
    return spark.table(name)


def write_bucketed(df: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Write a table with a file a bucket, and read it back with its buckets. One exchange, so that
    a bucket is written by one task and needs no merging when it is read; rows of a document stand
    together anyway."""
    name = f"written_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, KEY)
        .write.format("parquet")
        .bucketBy(buckets, KEY)
        .sortBy(KEY)
        .option("path", folder)
        .saveAsTable(name)
    )
    return df.sparkSession.table(name)
