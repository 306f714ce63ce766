"""Intermediate tables in the folder that driver and executors share."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where they go when a local session names no folder.
LOCAL_DIR = "file:///tmp/checkpoints"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; only a local session may leave that unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or LOCAL_DIR).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table there: it cuts the lineage and outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
