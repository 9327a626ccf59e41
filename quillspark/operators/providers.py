"""Extension points: providers of translations by name, and sources of hints that are asked one after the other.

A provider is a function from requests (segment_id, text, batch, attempt) to answers (segment_id, translated, error), both
frames, so its work runs on the cluster.  A source of hints is a function from items to hints (source, target, ...)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.grouping import by_precedence
from quillspark.operators.phases import STOPPED, Provider

HintSource = Callable[[DataFrame], DataFrame]
ANSWERS = "segment_id string, translated string, error string"
_KNOWN: dict[str, Callable[..., Provider]] = {}


def register(name: str, make: Callable[..., Provider]) -> None:
    """Makes a kind of provider known; ``make`` gets the settings that it is created with."""
    _KNOWN[name.lower()] = make


def create(name: str, **settings) -> Provider:
    if name.lower() not in _KNOWN:
        raise ValueError(f"no provider {name}; there are {', '.join(sorted(_KNOWN))}")
    return _KNOWN[name.lower()](**settings)


def by_batches(translate: Callable[[list[str]], list[str | None]]) -> Provider:
    """A provider from a function of texts, which is called once for each Arrow batch of requests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = translate(batch["text"].tolist())
            yield pd.DataFrame({"segment_id": batch["segment_id"], "translated": texts, "error": None}, columns=["segment_id", "translated", "error"])

    return lambda requests: requests.select("segment_id", "text").mapInPandas(run, ANSWERS)


def composite(*sources: HintSource) -> HintSource:
    """A source that asks others, of which the last that has a hint for a term counts."""
    return lambda items: by_precedence([s(items) for s in sources], ["source"])


class Ledger:
    """Answers that were given, under a folder, so that a request is paid for once: a run that was stopped, or lost, is taken
    up where it was.  A request is known by its segment, the text that was asked for and the attempt."""

    KEYS = ["segment_id", "asked", "attempt"]

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def answers(self) -> DataFrame:
        """(segment_id, asked, attempt, translated, error) of all waves that were written whole."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        waves = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        whole = [w.toString() for w in waves if fs.exists(jvm.org.apache.hadoop.fs.Path(w, "_SUCCESS"))]
        schema = "segment_id string, asked string, attempt int, translated string, error string"
        return self.spark.read.schema(schema).parquet(*whole) if whole else self.spark.createDataFrame([], schema)

    def kept(self, provider: Provider, waves: int = 1, stop: Callable[[], bool] = lambda: False) -> Provider:
        """A provider that asks the given one only for what is not in the ledger, in ``waves`` of batches, each written before
        the next; once ``stop()`` is true no more is asked, and what is left has the error STOPPED."""

        def run(requests: DataFrame) -> DataFrame:
            own = requests.withColumn("asked", F.sha2("text", 256)).withColumn("attempt", F.col("attempt").cast("int"))
            for wave in range(waves):
                if stop():
                    break
                left = own.where(F.pmod("batch", F.lit(waves)) == wave).join(self.answers(), self.KEYS, "left_anti")
                if left.isEmpty():
                    continue
                got = left.select(*self.KEYS).join(provider(left.select("segment_id", "text", "batch", "attempt")), "segment_id")
                got.select(*self.KEYS, "translated", "error").write.parquet(f"{self.path}/{uuid.uuid4().hex}")
            known = own.select(*self.KEYS).join(self.answers(), self.KEYS, "left").withColumn("known", F.col("translated").isNotNull() | F.col("error").isNotNull())
            error = F.when(F.col("known"), F.col("error")).when(F.lit(stop()), F.lit(STOPPED))
            return known.select("segment_id", "translated", error.alias("error"))

        return run


register("same", lambda: by_batches(lambda texts: list(texts)))
