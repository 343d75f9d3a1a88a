"""What the operators share: input tables, whole texts, staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))


def held_out(key: Column | str, of: int) -> Column:
    """True for the rows whose crc32 of the key as text leaves no remainder."""
    key = key if isinstance(key, Column) else F.col(key)
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % of == 0, F.lit(False))


class Stage:
    """Tables of one run in the shared folder of the cluster (`spark.checkpoint.dir`).

    A written table cuts the lineage and survives lost executors. Without the setting only a local
    session may use a temporary folder.
    """

    def __init__(self, spark: SparkSession):
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
            shared = os.path.join(tempfile.gettempdir(), "checkpoints")
        small_batches(spark)
        self.spark, self.folder = spark, f"{shared.rstrip('/')}/llm-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")


def spread(df: DataFrame, tasks_at_least: int | None = None) -> DataFrame:
    """Share out a table that is read in fewer parts than there are cores."""
    cores = tasks_at_least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what a Python worker holds at once: long texts make default batches hundreds of MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
