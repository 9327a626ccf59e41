"""Progress as a stream: batches of changes merged into versioned tables, latest change of a key winning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.grouping import keep_last


class VersionedTable:
    """Parquet versions under a folder, and the number of the current one; a version is written whole, then named.

    The pointer is a one-row table of its own, written last, so a reader sees the old version or the new one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        done = [s.getPath() for s in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done)

    def read(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/versions/{versions[-1]}") if versions else None

    def write(self, df: DataFrame) -> int:
        number = (self._versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/versions/{number}")
        self.spark.range(1).select(F.lit(number).alias("version")).write.mode("overwrite").parquet(f"{self.path}/pointers/{number}")
        return number

    def upsert(self, changes: DataFrame, keys: list[str], order: str) -> int:
        current = self.read()
        both = changes if current is None else current.unionByName(changes)
        return self.write(keep_last(both, keys, [F.col(order)]))

    def delete(self, keys: DataFrame) -> int:
        """Without the rows of the keys; where there is no version yet, there is nothing to delete (0)."""
        current = self.read()
        return 0 if current is None else self.write(current.join(keys, keys.columns, "left_anti"))

    def snapshot(self, rows: DataFrame, keys: list[str]) -> int:
        """The rows in place of what there was: equal keys are updated, keys that are gone are deleted, in one version."""
        return self.write(rows.dropDuplicates(keys))

    def clear(self) -> int:
        current = self.read()
        return 0 if current is None else self.write(current.limit(0))

    def vacuum(self, keep: int = 2) -> list[int]:
        """Removes all versions but the newest ``keep``, pointers first, so that no pointer is left without its version."""
        old = self._versions()[: -max(1, keep)]
        jvm = self.spark._jvm
        for number in old:
            for part in ("pointers", "versions"):
                path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}/{number}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return old

    def follow(self, stream: DataFrame, keys: list[str], order: str, checkpoint: str):
        """Starts a streaming query that merges each micro-batch; a batch that is run again changes nothing more."""
        return stream.writeStream.foreachBatch(lambda batch, _: self.upsert(batch, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hit_counts(log: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, hits): the latest value of each key and how often it was looked up."""
    return log.groupBy(key).agg(F.max_by(value, order).alias(value), F.count("*").alias("hits"))
