"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts counts the distinct character n-grams (1 to ``MAX_N`` characters,
lower-cased, n-grams of each length) that both hold, normalised by the two texts' own counts.  ``LANDMARKS`` training
texts span a Nyström approximation of its feature space, and one ridge regression per language (one-versus-rest,
targets +1 and -1, closed form) is fitted on at most ``TRAINING_ROWS`` labelled rows, the documented bound of the fit.
Texts are scored in batches: presence matrix x landmark matrix x weights.

Texts are presented to the kernel whole, whatever their length; n-grams are hashed to ``BITS`` positions, so presence
is a bit vector of fixed size.  It is wide enough for texts of several MB: a text of 100,000 distinct n-grams sets about
half of it.  As the product of the three matrices is associative, landmarks and weights are multiplied once (positions x
languages), and a batch of texts is one sparse presence matrix times that.

The rows of the fit are those of least seeded hash of (key, text) in each language, equal ones counted once and rows that
cannot be learned from not counted, so the model depends on the usable rows alone, however many others there are.

Defined results: a text that is null or holds no letter is ``und`` with score 0; so is every text if no labelled row is
there to learn from; with one language, that language is predicted; repeated rows are predicted alike; rows with a
null label or text are not learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import _words as W

MAX_N = 4
BITS = 1 << 17
_SHIFT = np.uint64(64 - 17)
LANDMARKS = 256
TRAINING_ROWS = 3000
#: The languages with most distinct rows are learned, so many at most.
LANGUAGES = 1000
RIDGE = 1e-3
UNKNOWN = "und"
#: Characters and rows of a scored batch.
BATCH_CHARS, BATCH_ROWS = 1 << 19, 64
SEED = 11


def presence(texts: list[str]) -> np.ndarray:
    """The (texts x BITS) boolean presence matrix of hashed character n-grams."""
    out = np.zeros((len(texts), BITS), dtype=bool)
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in lower])
    row = np.repeat(np.arange(len(texts)), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(codes))
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, MAX_N + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(1)
        whole = at[: len(h)] + n <= end[: len(h)]
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[row[: len(h)][whole], (mixed >> _SHIFT).astype(np.int64)[whole]] = True
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled so that each text's kernel with itself is 1."""
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    """Languages, and landmarks x weights: the weight of each position for each language."""

    languages: list[str]
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        found = presence(texts)
        counts = found.sum(axis=1)
        at = np.flatnonzero(found.reshape(-1)) & (BITS - 1)
        # rows of the sparse matrix, laid end to end, times the weights
        starts = np.minimum(np.concatenate([[0], np.cumsum(counts)[:-1]]), max(len(at) - 1, 0))
        sums = np.add.reduceat(self.weights[at], starts, axis=0) if len(at) else np.zeros((len(texts), len(self.languages)), np.float32)
        sums[counts == 0] = 0
        return sums / np.sqrt(np.maximum(counts, 1))[:, None]


def unpacked(bits: np.ndarray) -> np.ndarray:
    return unit(np.unpackbits(bits, axis=1).astype(np.float32))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [np.packbits(presence([t.as_py()])[0]).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(bits, pa.binary())], ["label", "bits"])


def fit(labelled: DataFrame, label_col: str, text_col: str, key_col: str, rows: int = TRAINING_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """The model of at most ``rows`` labelled rows, drawn evenly over the languages by a seeded hash of the key and the text."""
    spark = labelled.sparkSession
    own = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    own = own.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), F.xxhash64(F.lit(SEED), F.col(key_col), F.col(text_col)).alias("h"))
    # what can be drawn are distinct usable rows; a sketch of them decides how many are looked at, never which are the first
    known = own.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.col("n").desc(), "label").limit(LANGUAGES).collect()
    if not known:
        return None
    each = max(1, rows // len(known))
    chances = spark.createDataFrame([(r["label"], min(1.0, (2 * each + 1000) / r["n"])) for r in known], f"label {own.schema['label'].dataType.simpleString()}, chance double")
    own = own.join(F.broadcast(chances), "label").where(F.pmod("h", F.lit(1 << 30)) / (1 << 30) < F.col("chance"))
    own = own.groupBy("label", "h").agg(F.min("text").alias("text"))
    ranked = own.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))).where(F.col("n") <= each)
    drawn = ranked.select("label", "text").transform(W.mapped, _pack, f"label {own.schema['label'].dataType.simpleString()}, bits binary")
    got = sorted((r["label"], bytes(r["bits"])) for r in drawn.collect())
    if not got:
        return None
    bits = np.frombuffer(b"".join(b for _, b in got), np.uint8).reshape(len(got), -1)
    languages = sorted({k for k, _ in got})
    order = np.random.default_rng(SEED).permutation(len(got))
    y = np.array([[1.0 if k == lang else -1.0 for lang in languages] for k, _ in got])
    # landmarks: the same number of each language, as far as there are rows
    picked: list[int] = []
    for lang in languages:
        picked += [i for i in order.tolist() if got[i][0] == lang][: max(1, landmarks // len(languages))]
    z = unpacked(bits[picked])
    # kernels by blocks of rows: the whole presence matrix would be large
    knm = np.concatenate([unpacked(bits[k : k + 64]) @ z.T for k in range(0, len(bits), 64)]).astype(np.float64)
    kmm = knm[picked]
    # ridge regression in the Nyström space: the penalty is w' K w
    weights = np.linalg.solve(knm.T @ knm + RIDGE * len(got) * kmm + 1e-8 * np.eye(len(picked)), knm.T @ y)
    return Model(languages, (z.T @ weights.astype(np.float32)).astype(np.float32))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The documents with lang_pred and score."""
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*(F.col(f"`{c}`") for c in columns))
    if model is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            _, offsets = W.text_buffers(text)
            names, scores = np.full(batch.num_rows, len(own.languages)), np.zeros(batch.num_rows)
            for lo, hi in W.chunks(offsets, BATCH_CHARS):
                for a in range(lo, hi, BATCH_ROWS):
                    part = text.slice(a, min(BATCH_ROWS, hi - a)).to_pylist()
                    known = [i for i, t in enumerate(part) if has_letter(t)]
                    if known:
                        s = own.scores([part[i] for i in known])
                        at = a + np.array(known)
                        names[at] = s.argmax(axis=1)
                        scores[at] = np.clip((s.max(axis=1) + 1) / 2, 0, 1)
            labels = pa.array([*own.languages, UNKNOWN]).take(pa.array(names))
            yield pa.RecordBatch.from_arrays([*batch.columns, labels, pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.transform(W.mapped, run, f"{schema}, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held), "lang", "text", "doc_id")
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
