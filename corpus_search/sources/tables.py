"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Share out a table that is read in fewer parts than there are cores, so that heavy work per
    row uses the whole cluster. A large table has more parts than cores and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def state_of(spark: SparkSession, *paths: str) -> tuple:
    """Path, size and time of every file of the tables; another state when one was replaced."""
    found = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        status = files.listStatus(at) if files.exists(at) else []
        found += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in status]
    return tuple(sorted(found))
