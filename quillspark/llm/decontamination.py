"""Benchmark decontamination by winnowing.

The words of a text are runs of 0-9, a-z and non-ASCII characters after A-Z is lower-cased.  Of every nine
neighbouring 5-word hashes the smallest is kept as a fingerprint, on both sides, so that any span of 13 shared words
shares one.  Document fingerprints are joined with those of the benchmark, and each hit is compared word by word and
extended to the longest equal run; runs that hold a window of an item are its occurrences.  An item of fewer than 13
words is one window; its whole-item hash is its only fingerprint (winnowing of width 1 at that length).

The benchmark is the small side: it is measured first and dealt into blocks of at most ``block_bytes`` of text, each
broadcast on its own, and the documents flow through one join after the other.  Documents are never shuffled.  After
``AT_ONCE`` blocks the marked documents are written and read again and the blocks are let go of, so that an executor
never holds more of the benchmark than that, whatever its size.

Defined results: null and empty texts have no words, no hits and no items; items without words never occur; null item
ids are left out of the item list; repeated items or documents each count as themselves (item ids are listed once);
columns of the documents pass through untouched unless they clash with a column added here, which then replaces them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import _words as W
from quillspark.llm._shared import Workspace, positional

WINDOW = 13
GRAM = 5
BLOCK_BYTES = 8 << 20
AT_ONCE = 8
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_FOLD = {c: c + 32 for c in range(65, 91)}
ADDED = "n_words long, n_hit long, hit_spans array<struct<start: long, end: long>>, items array<string>"


def split_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_FOLD))


class Fingerprints:
    """Fingerprints of a block of benchmark items, by gram length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, gram: int):
        self.window, self.gram = window, gram
        rows = [(i, w) for i, t in items if (w := split_words(t))]
        self.ids, self.words = [r[0] for r in rows], [r[1] for r in rows]
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        column = pa.array([" ".join(w) for w in self.words], pa.large_string())
        for w in W.words(column):
            doc = w.doc_of()
            at = np.arange(len(doc)) - w.first[doc]
            size = w.counts()[doc]
            for k in sorted({gram, *np.unique(size[size < window]).tolist()}):
                hashes, whole = W.grams(w, k)
                kept = (size == k) & (at == 0) & (size < window)
                if k == gram:
                    kept = kept | (W.winnow(hashes, window - gram + 1) & (size >= window))
                kept &= whole
                found.setdefault(k, []).append((hashes[kept], doc[kept] + w.lo, at[kept]))
        self.tables = {}
        for k, parts in found.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            keys, first = np.unique(h[order], return_index=True)
            if len(keys):
                self.tables[k] = (keys, np.append(first, len(h)), item[order], at[order], bool((np.array([len(self.words[i]) for i in item]) < window).any()))

    def lookup(self, w: W.Words) -> dict[int, list[tuple[int, int, int]]]:
        """Hits (word, item, item word) by document."""
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for k, (keys, first, item, item_at, short) in self.tables.items():
            hashes, whole = W.grams(w, k)
            tried = whole if short else W.winnow(hashes, self.window - k + 1)
            at = np.flatnonzero(tried)
            place = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
            same = keys[place] == hashes[at]
            at, place = at[same], place[same]
            doc = np.searchsorted(w.first, at, "right") - 1
            for p, d, x in zip(at.tolist(), doc.tolist(), place.tolist(), strict=True):
                own = hits.setdefault(d, [])
                own += [(p - int(w.first[d]), int(item[j]), int(item_at[j])) for j in range(first[x], first[x + 1])]
        return hits

    def extend(self, text: list[str], hits: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], set[int]]:
        """The maximal equal runs through the hits that hold a window of their item, and those items."""
        ends: dict[tuple[int, int], int] = {}
        spans, items = [], set()
        for p, i, q in sorted(hits):
            own = self.words[i]
            if ends.get((i, p - q), -1) > p or text[p] != own[q]:
                continue
            a, b = 0, 1
            while a < min(p, q) and text[p - a - 1] == own[q - a - 1]:
                a += 1
            most = min(len(text) - p, len(own) - q)
            while b < most and text[p + b] == own[q + b]:
                b += 1
            ends[i, p - q] = p + b
            if a + b >= min(self.window, len(own)):
                spans.append((p - a, p + b))
                items.add(i)
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _marker(table, text_col: str, first: bool):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = table.value
        for batch in batches:
            n = batch.num_rows
            column = batch.column(batch.schema.get_field_index(text_col))
            own = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            counts = np.zeros(n, dtype=np.int64)
            spans: list[list[tuple[int, int]]] = [[]] * n
            items: list[list[str]] = [[]] * n
            if not first:
                spans = [[(s["start"], s["end"]) for s in x] for x in own["hit_spans"].to_pylist()]
                items = own["items"].to_pylist()
            for w in W.words(column):
                counts[w.lo : w.hi] = w.counts()
                for d, hits in bench.lookup(w).items():
                    got, which = bench.extend(split_words(column[w.lo + d].as_py()), hits)
                    if got:
                        spans[w.lo + d] = merged(spans[w.lo + d] + got)
                        items[w.lo + d] = sorted({*items[w.lo + d], *(bench.ids[i] for i in which if bench.ids[i] is not None)})
            own["n_words"] = pa.array(counts, pa.int64())
            own["n_hit"] = pa.array([sum(b - a for a, b in x) for x in spans], pa.int64())
            own["hit_spans"] = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            own["items"] = pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(own.values()), names=list(own))

    return mark


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with n_words, n_hit, hit_spans (merged word ranges) and items (ids of the items that occur)."""
    spark: SparkSession = docs.sparkSession
    bench = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text")).where("text is not null")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    added = T.StructType.fromDDL(ADDED)
    kept = [c for c in docs.columns if c not in added.names]
    out = docs.select(*(F.col(f"`{c}`") for c in kept))
    space, held = Workspace(spark, "decontaminate"), []
    for k in range(blocks):
        if len(held) == AT_ONCE:
            out = space.save(out, f"marked-{k}")
            for old in held:
                old.unpersist()
            space.keep(f"marked-{k}")
            held = []
        rows = [(r.id, r.text) for r in bench.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).toLocalIterator()]
        table = spark.sparkContext.broadcast(Fingerprints(rows, window, gram))
        held.append(table)
        schema = T.StructType([*(f for f in out.schema.fields if f.name not in added.names), *added.fields])
        out = out.transform(W.mapped, _marker(table, text_col, k == 0), schema)
    return out


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated."""
    plain, name = positional(docs)
    return decontaminate(plain, benchmark, name[text_col]).where(~is_contaminated()).select(*plain.columns).toDF(*docs.columns)


#: The words of a text in SQL.
LOWER_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS id, {LOWER_WORDS} AS w FROM benchmark),
w AS (SELECT DISTINCT id, least(13, len(w)) AS k, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g
      FROM b, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM w),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({LOWER_WORDS}, []) AS w FROM documents),
h AS (SELECT DISTINCT r, i, w.k, id
      FROM (SELECT r, k, i, array_to_string(list_slice(d.w, i, i + k - 1), ' ') AS g
            FROM d, ks, unnest(generate_series(1, len(d.w) - k + 1)) AS s(i)) x
      JOIN w ON w.g = x.g AND w.k = x.k),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, array_to_string(list_sort(list(id)), ',') AS ids
      FROM (SELECT DISTINCT r, id FROM h WHERE id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
