"""Exchanging states with a server: applying what it has, and finding what it lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.grouping import keep_last


def applied(items: DataFrame, work_items: DataFrame, shared_keys: DataFrame) -> DataFrame:
    """Items (segment_id, namespace, key, translation, submitted) with the server's work item (segment_id, server) put
    in where the item was not changed since it was submitted, and then the shared key (namespace, key, shared)."""
    out = items.join(work_items, "segment_id", "left").join(shared_keys, ["namespace", "key"], "left")

    def clean(column: str):
        return (F.coalesce("submitted", F.lit("")) == "") | (F.coalesce(column, F.lit("")) == F.col("submitted"))

    first = F.when(F.col("server").isNotNull() & clean("translation"), F.col("server")).otherwise(F.col("translation"))
    out = out.withColumn("translation", first)
    second = F.when(F.col("shared").isNotNull() & clean("translation"), F.col("shared")).otherwise(F.col("translation"))
    return out.withColumn("translation", second).select(*items.columns)


def changed(items: DataFrame, submitted: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key whose translation differs from what was last submitted (nulls are equal)."""
    last = keep_last(items, [key], [F.col(order)])
    sent = submitted.select(key, F.col("translation").alias("__sent"), F.lit(True).alias("__was"))
    out = last.join(sent, key, "left")
    return out.where(F.col("__was").isNull() | ~F.col("translation").eqNullSafe(F.col("__sent"))).select(*items.columns)
