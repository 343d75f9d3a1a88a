"""Intermediate tables in the folder the cluster shares.

A staged table cuts the lineage, survives the loss of executors, and is read back with column
pruning and a size the planner knows. Zstandard writes texts and scores smaller than the default.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_folder(spark: SparkSession) -> str:
    """A new folder under `spark.checkpoint.dir`; only a session without that setting (a local
    test) gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        return tempfile.mkdtemp(prefix="run-")
    return f"{shared.rstrip('/')}/run-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str, **options: str | int) -> DataFrame:
    """The table, written and read back; `options` are the writer's."""
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
