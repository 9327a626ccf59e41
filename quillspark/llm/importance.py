"""Quality classifier by importance resampling.

Tokens are runs of letters and digits, or of punctuation, of the lower-cased text; features are their 1- and 2-grams,
hashed to ``BUCKETS`` buckets.  Two generative models share the buckets: the target (documents labelled good) and the
raw text (every document of the corpus).  A document's log importance is the sum over its features of
log p_target - log p_raw.  Gumbel noise, seeded by the document's key, is added, and the k documents of largest sum are
kept: a sample without replacement in proportion to importance.  k is the number of documents, over the whole corpus,
whose log importance is at least the exact quantile ``LOST`` of the held-out good documents.

The target model and that level are fitted on at most ``LABELLED_ROWS`` documents labelled good, those of least seeded hash
of the id (the documented bound; they are broadcast); raw counts, scores and k cover every document.

Defined results: a text without a token (null or empty) has no importance and is rejected; without any labelled good
document every other document is kept with importance 0; ties at the k-th place are all kept; repeated rows are scored
alike; null labels count as not good; columns named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _words as W
from quillspark.llm._shared import Workspace, positional

BITS = 18
BUCKETS = 1 << BITS
SMOOTHING = 5.0
LABELLED_ROWS = 20_000
LOST = 0.01
SEED = 5
ADDED = ("importance", "gumbel_key")

#: 1: letters, digits and bytes of non-ASCII characters; 2: punctuation.
KINDS = np.zeros(256, np.uint8)
KINDS[33:127] = 2
KINDS[48:58] = KINDS[65:91] = KINDS[97:123] = KINDS[128:] = 1


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows with the buckets of their features and the row (from the range's first) of each."""
    shift = np.uint64(64 - BITS)
    for w in W.words(column, KINDS, W.LOWER):
        pairs, whole = W.grams(w, 2)
        doc = w.doc_of()
        single = (W.mix(w.hashes ^ np.uint64(1)) >> shift).astype(np.int64)
        yield w.lo, w.hi, np.concatenate([single, (pairs[whole] >> shift).astype(np.int64)]), np.concatenate([doc, doc[whole]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column("target").to_numpy(zero_copy_only=False)
        for lo, hi, bucket, row in features(batch.column("text")):
            raw += np.bincount(bucket, minlength=BUCKETS)
            if good[lo:hi].any():
                target += np.bincount(bucket[good[lo:hi][row]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    for k in range(0, len(at), 1 << 16):
        part = at[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(raw[part]), pa.array(target[part])], ["bucket", "raw", "target"])


@dataclass
class Model:
    """log ratio of each bucket, and the log importance that counts as good."""

    ratio: np.ndarray
    level: float = float("-inf")

    def sums(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        total, n = np.zeros(len(column)), np.zeros(len(column))
        for lo, hi, bucket, row in features(column):
            total[lo:hi] = np.bincount(row, self.ratio[bucket], minlength=hi - lo)
            n[lo:hi] = np.bincount(row, minlength=hi - lo)
        return total, n


def labelled_sample(labels: DataFrame, id_col: str, rows: int, space: Workspace) -> DataFrame:
    """(id, held): of the ids that all their labels call good, at most ``rows``, those of least seeded hash; one in five is
    held out of the fit.  Labels are put together by id before anything is counted, so repeats change nothing."""
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    each = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(good).alias("good"))
    each = space.save(each.where("good").select("__id"), "good")
    # about twice the rows are sorted, of which the first are taken
    h = F.xxhash64(F.lit(SEED), F.col("__id"))
    chance = min(1.0, (2 * rows + 1000) / max(each.count(), 1))
    drawn = each.where(F.pmod(h, F.lit(1 << 30)) / (1 << 30) < chance).orderBy(F.pmod(h, F.lit(1 << 30)), h, "__id").limit(rows)
    return drawn.withColumn("held", F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("__id")), F.lit(5)) == 0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = LABELLED_ROWS) -> Model | None:
    space = Workspace(docs.sparkSession, "importance")
    sample = F.broadcast(space.save(labelled_sample(labels, id_col, rows, space), "sample"))
    own = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("text"))
    fitted = own.join(sample, "__id", "left").select("text", F.coalesce(~F.col("held"), F.lit(False)).alias("target"))
    counts = fitted.transform(W.mapped, _count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    if not target.sum():
        return None
    expected = raw * (target.sum() / raw.sum())
    model = Model(np.log((target + SMOOTHING) / (expected + SMOOTHING)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, n = shared.value.sums(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(n), batch.column("held")], ["total", "n", "held"])

    seen = own.join(sample, "__id").select("text", "held").transform(W.mapped, sums, "total double, n double, held boolean").where("n > 0")
    seen = space.save(seen, "seen")
    any_held = seen.agg(F.coalesce(F.bool_or("held"), F.lit(False))).first()[0]
    # repeated rows of a labelled document weigh as often as they come; the quantile is exact
    level = seen.where("held" if any_held else "true").agg(F.percentile("total", LOST)).first()[0]
    model.level = float("-inf") if level is None else level
    space.keep()
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with importance (null without a token) and gumbel_key."""
    columns = [c for c in docs.columns if c not in ADDED]
    h = F.xxhash64(F.lit(SEED), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    own = docs.select(*(F.col(f"`{c}`") for c in columns), h.alias("__h"))
    shared = docs.sparkSession.sparkContext.broadcast(model or Model(np.zeros(BUCKETS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, n = shared.value.sums(batch.column(batch.schema.get_field_index(text_col)))
            bits = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            noise = -np.log(-np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)))
            none = n == 0
            out = [pa.array(total, mask=none), pa.array(total + noise, mask=none)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*columns, *ADDED])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.transform(W.mapped, run, f"{schema}, importance double, gumbel_key double")


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest value of the column gumbel_key, by histograms that close in on it."""
    keys = keys.select("gumbel_key").where("gumbel_key is not null")
    lo, hi, n = keys.agg(F.min("gumbel_key"), F.max("gumbel_key"), F.count("*")).first()
    if k <= 0 or not n:
        return float("inf")
    above, k = 0, min(k, n)
    while True:
        here = keys.where(F.col("gumbel_key").between(lo, hi))
        size = here.count()
        if size <= bins or lo == hi:
            return sorted((r[0] for r in here.limit(bins + 1).collect()), reverse=True)[k - above - 1] if size <= bins else lo
        width = (hi - lo) / bins
        bin_of = F.least(F.floor((F.col("gumbel_key") - lo) / width), F.lit(bins - 1))
        rows = here.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min("gumbel_key").alias("lo"), F.max("gumbel_key").alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]


def threshold(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, Model | None, float]:
    """The scores of ``carry`` as a written table, the model, and the least gumbel_key that is kept."""
    space = Workspace(docs.sparkSession, "importance")
    model = fit(docs, labels, id_col, text_col)
    scored = space.save(score(docs, model, id_col, text_col).select(*(carry or [id_col]), *ADDED), "scores")
    k = scored.where(F.col("importance") >= F.lit(model.level if model else float("-inf"))).count()
    return scored, model, kth_largest(scored, k)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the sample keeps."""
    plain, name = positional(docs)
    key, text = name[id_col], name[text_col]
    renamed = labels.withColumnRenamed(id_col, key)
    _, model, least = threshold(plain, renamed, key, text)
    return score(plain, model, key, text).where(F.col("gumbel_key") >= least).select(*plain.columns).toDF(*docs.columns)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored, _, least = threshold(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "importance", "gumbel_key", F.coalesce(F.col("gumbel_key") >= least, F.lit(False)).alias("kept"))
