"""A session of several tables that change together: one commit names the new state of all of them, or changes nothing.

Rows are dealt to ``groups`` file groups by a hash of their keys.  A commit writes anew only the groups that its changes
touch; a manifest, one small file a commit, lists the folder of each group of each table and is put in place last, by a
rename that fails if another commit took the number.  A reader sees the state before or the state after, and old states
stay readable until they are removed."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.grouping import keep_last

GROUP = "__group"


class Conflict(RuntimeError):
    """Another commit came first."""


@dataclass
class Change:
    """What a commit does to a table: rows to put in, of which the last in ``order`` counts for each key, and keys to go."""

    keys: list[str]
    upserts: DataFrame | None = None
    deletes: DataFrame | None = None
    order: str | None = None


@dataclass
class Manifest:
    """number; by table the folder of each group; the schema of each table; and the tokens of the commits it holds."""

    number: int = 0
    folders: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    tokens: dict[str, str] = field(default_factory=dict)


class Session:
    """The tables under a folder.  ``groups`` is fixed by the first commit's user; it bounds how much one change rewrites."""

    def __init__(self, spark: SparkSession, path: str, groups: int = 64):
        self.spark, self.path, self.groups = spark, path.rstrip("/"), groups
        self._jvm = spark._jvm

    def _at(self, path: str):
        own = self._jvm.org.apache.hadoop.fs.Path(path)
        return own.getFileSystem(self.spark._jsc.hadoopConfiguration()), own

    def numbers(self) -> list[int]:
        fs, folder = self._at(f"{self.path}/manifests")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []

    def manifest(self, number: int | None = None) -> Manifest:
        numbers = self.numbers()
        if not numbers:
            return Manifest()
        fs, file = self._at(f"{self.path}/manifests/{numbers[-1] if number is None else number}")
        stream = fs.open(file)
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return Manifest(**json.loads(text))

    def read(self, table: str, number: int | None = None) -> DataFrame | None:
        """The table as of a commit, the last one by default; None if it is not there."""
        now = self.manifest(number)
        if table not in now.schemas:
            return None
        return self._read(now, table, sorted(now.folders.get(table, {})))

    def _read(self, now: Manifest, table: str, groups: list[str]) -> DataFrame:
        paths = [now.folders[table][g] for g in groups if g in now.folders.get(table, {})]
        schema = now.schemas[table]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def group_of(self, keys: list[str]):
        return F.pmod(F.xxhash64(*keys), F.lit(self.groups)).cast("int")

    def commit(self, changes: dict[str, Change], token: tuple[str, int] | None = None) -> int:
        """Makes all changes one new state and returns its number.  ``token`` (stream, batch) makes a repeated batch do
        nothing.  A failure, or a commit of another writer in the meantime, leaves the state as it was."""
        now = self.manifest()
        if token is not None and int(now.tokens.get(token[0], -1)) >= token[1]:
            return now.number
        out = Manifest(now.number + 1, {t: dict(g) for t, g in now.folders.items()}, dict(now.schemas), dict(now.tokens))
        for table, change in changes.items():
            self._apply(now, out, table, change)
        if token is not None:
            out.tokens[token[0]] = str(token[1])
        self._publish(out)
        return out.number

    def _apply(self, now: Manifest, out: Manifest, table: str, change: Change) -> None:
        parts = [df.select(self.group_of(change.keys).alias(GROUP)) for df in (change.upserts, change.deletes) if df is not None]
        touched: set[int] = set()
        for part in parts:
            # at most ``groups`` numbers
            touched |= {r[0] for r in part.distinct().collect()}
        schema = now.schemas.get(table)
        if schema is None and change.upserts is not None:
            schema = out.schemas[table] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in change.upserts.schema)
        if not touched or schema is None:
            return
        rows = self._read(now, table, [str(g) for g in touched]) if table in now.schemas else self.spark.createDataFrame([], schema)
        if change.deletes is not None:
            rows = rows.join(change.deletes.select(*change.keys), change.keys, "left_anti")
        if change.upserts is not None:
            new = change.upserts.select(*rows.columns)
            new = keep_last(new, change.keys, [F.col(change.order)]) if change.order else new.dropDuplicates(change.keys)
            rows = rows.join(new.select(*change.keys), change.keys, "left_anti").unionByName(new)
        folder = f"{self.path}/data/{table}/{uuid.uuid4().hex}"
        rows = rows.withColumn(GROUP, self.group_of(change.keys))
        rows.repartition(GROUP).write.partitionBy(GROUP).parquet(folder)
        fs, root = self._at(folder)
        written = {s.getPath().getName().split("=")[1]: s.getPath().toString() for s in fs.listStatus(root) if "=" in s.getPath().getName()}
        own = out.folders.setdefault(table, {})
        for g in map(str, touched):
            own.pop(g, None)
            if g in written:
                own[g] = written[g]

    def _publish(self, out: Manifest) -> None:
        fs, file = self._at(f"{self.path}/manifests/{out.number}")
        _, temporary = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = fs.create(temporary, False)
        stream.write(bytearray(json.dumps(out.__dict__).encode()))
        stream.close()
        if fs.exists(file) or not fs.rename(temporary, file):
            fs.delete(temporary, False)
            raise Conflict(f"commit {out.number} is taken")

    def vacuum(self, keep: int = 2) -> list[int]:
        """Removes all states but the newest ``keep``, and the folders that none of those reads."""
        numbers = self.numbers()
        old, kept = numbers[: -max(1, keep)], numbers[-max(1, keep) :]
        used = {f for n in kept for groups in self.manifest(n).folders.values() for f in groups.values()}
        gone = {f for n in old for groups in self.manifest(n).folders.values() for f in groups.values()} - used
        for path in [f"{self.path}/manifests/{n}" for n in old] + sorted(gone):
            fs, own = self._at(path)
            fs.delete(own, True)
        return old

    def follow(self, stream: DataFrame, table: str, keys: list[str], order: str, checkpoint: str):
        """Starts a streaming query that commits each micro-batch once, even if the batch is run again."""

        def merge(batch: DataFrame, number: int) -> None:
            self.commit({table: Change(keys, batch, order=order)}, token=(checkpoint, number))

        return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
