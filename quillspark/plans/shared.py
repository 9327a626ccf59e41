"""Intermediate tables in the folder that all executors share, to cut the lineage of iterative plans."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the folder that the session names in spark.checkpoint.dir; only a local session may name none."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "/tmp/checkpoints"
    return f"{folder.rstrip('/')}/{name}"


def saved(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, key: Column | str, most: int = 4096) -> DataFrame:
    """The rows dealt to tasks of about ``most`` rows each by a key that tells them apart.  Small files of many rows are read
    by a task or two; where each row is much work, that work would not be shared out."""
    parts = math.ceil(rows.count() / most)
    return rows.repartition(parts, key) if parts > 1 else rows
