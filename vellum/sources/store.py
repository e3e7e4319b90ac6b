"""Tables in the folder that driver and executors share: intermediate results and stored structures."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Broadcast sides of up to so many thin rows; beyond it the same join shuffles.
BROADCAST_ROWS = 500_000
#: About so many rows of a large table are sorted by one task, however well its shuffled columns are packed.
TASK_ROWS = 500_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in spark.checkpoint.dir, or in a folder of our own on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "vellum-store")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows doesn't make it again, also when executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def thin(side: DataFrame) -> DataFrame:
    """``side`` as a broadcast if its count is within BROADCAST_ROWS, else as it is; it should be a written table."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by columns to as many tasks as keep TASK_ROWS each, if it has more; Spark itself counts packed bytes only."""
    parts = -(-df.count() // TASK_ROWS)
    return df.repartition(parts, *by) if parts > 1 else df
