"""Vector codes: product quantisation with integer codebooks, every assignment by Exponion search.

Components become integers floor(1024 x) and a vector is cut into ``parts`` equal parts, each with a codebook of at most
``entries`` entries.  A codebook starts as that part of the vectors of least id; each round assigns every part to its
nearest entry (squared Euclidean distance, ties to the lower index) and replaces each entry by the floor of the mean of
its parts.  After the last round the parts are assigned once more.

Exponion search: a part x starts at its entry a of the round before, U being their squared distance now.  An entry j no
further from x than a lies within twice that distance of a, so D(a, j) <= 4 U.  The other entries are sorted by their
distance from a once a round; a part is compared with the head of that list inside the radius, which holds every entry
that can win or tie.  All distances are exact integers.

Vectors flow through one ``mapInArrow`` a round; codes of a round are written beside the vectors and the table of the
round before is deleted.  Codebooks (``entries`` x length) are the only thing broadcast, and each task gives at most one
row of sums for each entry.

Defined results: rows whose vector is null, empty or holds a null, a NaN, an infinity or a component beyond +-16,384
(whose error would not fit in a long) are dropped, as are those of another length than the kept vector of least id; a
length that 4 does not divide is filled up with zeros; repeated rows and ids count as often as they come, equal ids are
ordered by vector, a null id comes last; fewer vectors than ``entries`` give as many entries; an empty table gives no
rows; null labels are one label; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _words as W
from quillspark.llm._shared import Workspace, salted_join

SCALE = 1024
LARGEST = 16_384
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Components held at once by a task, and entries compared at once.
CHUNK = 1 << 20
BLOCK = 64


@dataclass
class Books:
    """Codebooks (parts x entries x width) and the neighbour lists of each entry."""

    entries: np.ndarray
    order: np.ndarray
    away: np.ndarray

    @staticmethod
    def of(entries: np.ndarray) -> Books:
        gaps = np.stack([squared(e, e) for e in entries])
        order = np.argsort(gaps, axis=2, kind="stable")
        return Books(entries, order, np.take_along_axis(gaps, order, axis=2))

    def nearest(self, part: int, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry and squared distance of each row of x, searched from ``start``; and the distances worked out."""
        own, order, away = self.entries[part], self.order[part], self.away[part]
        best = ((x - own[start]) ** 2).sum(axis=1)
        at, compared = start.astype(np.int64), len(x)
        rows = np.argsort(start, kind="stable")
        edges = np.searchsorted(start[rows], np.arange(len(own) + 1))
        for a in np.flatnonzero(np.diff(edges)).tolist():
            group = rows[edges[a] : edges[a + 1]]
            # the entry itself is at distance 0 and inside every radius
            within = np.searchsorted(away[a], 4 * best[group], "right")
            by_reach = np.argsort(-within, kind="stable")
            group, within = group[by_reach], within[by_reach]
            for lo in range(0, int(within[0]), BLOCK):
                live = group[: np.searchsorted(-within, -lo, "left")]
                near = order[a, lo : min(lo + BLOCK, int(within[0]))]
                d = squared(x[live], own[near])
                compared += d.size
                least = d.min(axis=1)
                index = np.where(d == least[:, None], near, len(own)).min(axis=1)
                better = (least < best[live]) | ((least == best[live]) & (index < at[live]))
                best[live[better]], at[live[better]] = least[better], index[better]
        return at, best, compared

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from those of y, exact: in doubles while every term is below 2**53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Batches put together, about ``CHUNK`` components at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) * width >= CHUNK:
            yield pa.Table.from_batches(held)
            held = []
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _rows(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors (rows x components) and their codes (rows x parts)."""
    vectors = table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
    codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(vectors), -1)
    return vectors, codes


def assigned(df: DataFrame, books: Books) -> DataFrame:
    """The vectors (vec_id, label, q, code) with the codes of their nearest entries, and the error of each."""
    shared = df.sparkSession.sparkContext.broadcast(books)
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for table in _chunks(batches, parts * width):
            q, start = _rows(table, parts * width)
            codes, error = np.empty((len(q), parts), np.uint8), np.zeros(len(q), np.int64)
            for p in range(parts):
                at, d, _ = own.nearest(p, q[:, p * width : (p + 1) * width], start[:, p])
                codes[:, p], error = at, error + d
            code = pa.array([c.tobytes() for c in codes], pa.binary())
            columns = [*(table.column(c).combine_chunks() for c in ("vec_id", "label", "q")), code, pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "q", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select("vec_id", "label", "q", "code").mapInArrow(W.tidy(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, q array<int>, code binary, error long")


def moved(df: DataFrame, books: Books) -> Books:
    """The codebooks with each entry replaced by the floor of the mean of its parts; unused entries stay."""
    parts, n, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros((parts, n), np.int64), np.zeros((parts, n, width), np.int64)
        for table in _chunks(batches, parts * width):
            q, codes = _rows(table, parts * width)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=n)
                for k in range(width):
                    # a chunk's sums are far below 2**53
                    sums[p, :, k] += np.bincount(codes[:, p], q[:, p * width + k], n).astype(np.int64)
        p, e = np.nonzero(count)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(sums[p, e].reshape(-1)), width).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), lists], ["p", "e", "n", "s"])

    each = df.select("q", "code").mapInArrow(W.tidy(run), "p int, e int, n long, s array<long>")
    total = each.groupBy("p", "e").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(width)))
    entries = books.entries.copy()
    for r in total.collect():
        entries[r["p"], r["e"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return Books.of(entries)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books | None]:
    """(vec_id, label, code, error) of the kept vectors, and the codebooks that the codes point into."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte")
    space = Workspace(vectors.sparkSession, "vector-codes")
    v = F.col(f"`{vector_col}`")
    whole = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) <= LARGEST))
    q = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    own = vectors.where(whole).select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), q.alias("q"))
    first = own.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(1).collect()
    if not first:
        return own.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), None
    length = len(first[0]["q"])
    own = own.where(F.size("q") == length)
    if length % parts:
        own = own.withColumn("q", F.concat("q", F.array_repeat(F.lit(0), parts - length % parts)))
    now = space.save(own.withColumn("code", F.lit(bytes(parts))), "codes-0")
    least = np.array([r["q"] for r in now.select("vec_id", "q").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()], np.int64)
    books = Books.of(np.ascontiguousarray(least.reshape(len(least), parts, -1).transpose(1, 0, 2)))
    for k in range(rounds):
        now = space.save(assigned(now, books).drop("error"), f"codes-{k + 1}")
        space.drop(f"codes-{k}")
        books = moved(now, books)
    last = space.save(assigned(now, books).drop("q"), "last")
    space.keep("last")
    return last, books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    # null labels are one label
    coded = coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    totals = coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = salted_join(coded, totals.select("key", "label_error"), "key", F.struct("vec_id", "code"), counts=totals.select("key", "n"))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL, one assignment and one replacement after the other."""
    steps = [
        "v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT r, CAST(floor((i - 1) / (len(embedding) / {PARTS})) AS INTEGER) AS p, i, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM v, unnest(generate_series(1, len(embedding))) s(i))",
        f"c0 AS MATERIALIZED (SELECT p, i, r - 1 AS e, x AS c FROM x WHERE r <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"d{k} AS (SELECT x.r, x.p, e, sum((x - c) * (x - c)) AS d FROM x JOIN c{k} USING (p, i) GROUP BY ALL)")
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p, min((d, e)) AS a FROM d{k} GROUP BY ALL)")
        if k < ROUNDS:
            steps.append(f"m{k} AS (SELECT x.p, i, struct_extract(a, 2) AS e, sum(x) // count(*) - CASE WHEN sum(x) % count(*) < 0 THEN 1 ELSE 0 END AS c FROM x JOIN a{k} USING (r, p) GROUP BY ALL)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT p, i, e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, i, e))")
    steps.append(f"o AS (SELECT r, string_agg(format('{{:02x}}', struct_extract(a, 2)), '' ORDER BY p) AS code, CAST(sum(struct_extract(a, 1)) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM c{ROUNDS})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN o USING (r), h"


OP12_SQL = _sql()
