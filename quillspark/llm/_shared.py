"""Tables written to the folder that all executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only where the session names no folder, as in tests.
FALLBACK = "/tmp/checkpoints"
#: A bitmap has 16 bits a key and 32 MB at most.
MOST_BITS = 1 << 28
HOT_ROWS = 128
HOT_SHARE = 2048


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a session on a cluster must name one, a local one may do without."""
    named, master = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or FALLBACK).rstrip("/")


class Workspace:
    """A folder of its own under the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """The frame as written to the folder and read again."""
        self.names.add(name)
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def keep(self, *names: str) -> None:
        """Deletes all tables but those that a result still reads."""
        for name in self.names - {*names}:
            self.drop(name)

    def drop(self, name: str) -> None:
        self.names = self.names - {name}
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@dataclass
class Bitmap:
    """Lower bits of hashes that are there; others may seem to be, so an exact join must follow."""

    data: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(8 * len(self.data) - 1)
        return ((self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def membership(keys: DataFrame, hashed: Column) -> Bitmap:
    """A bitmap of a long column of hashes; its size is bounded whatever the number of keys."""
    bits = 1 << 15
    n = min(16 * keys.count(), MOST_BITS)
    while bits < n:
        bits *= 2
    at = keys.select((F.pmod(hashed, F.lit(bits)) + 1).alias("h"))
    parts = at.groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    out = np.zeros(bits >> 3, dtype=np.uint8)
    for k, part in parts.toLocalIterator():
        out[(k - 1) * len(part) : k * len(part)] = np.frombuffer(bytes(part), np.uint8)
    return Bitmap(out)


def salted_join(left: DataFrame, right: DataFrame, key: str, row: Column, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left joined with right (rows of distinct keys) on the key column; keys with many rows on the left are dealt to
    several tasks by ``row``, a column that differs within a key, and their right rows are repeated as often.  ``counts``
    are the rows (key, n) of the left side by key, if they are known.

    A key is hot from HOT_ROWS rows and the HOT_SHARE-th part of all rows on, so the broadcast table of hot keys has
    at most HOT_SHARE rows whatever the input."""
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(HOT_ROWS, -(-total // HOT_SHARE))
    hot = F.broadcast(counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("__parts")))
    a = left.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(row), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    b = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return a.join(b, [key, "__salt"], how).drop("__salt")


def positional(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns c0, c1, ..., which no operator's own columns clash with, and the new name of each."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))
