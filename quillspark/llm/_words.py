"""Vectorised word tables over Arrow string columns, shared by the shingle-based operators.

A *word* is a maximal run of bytes of one class other than 0; documents never share a word.  Everything here is
bounded by ``CHUNK_BYTES`` of text (or by one document, if that is longer), never by the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch; Spark's 10,000 whole texts would be held four times over, in the JVM and in the worker.
BATCH_ROWS = 1000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
MAX_HASH = np.uint64(0xFFFFFFFFFFFFFFFF)

#: A-Z folded to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words of lower-cased text: 0-9, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        made = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers = (made[0], made[1])
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of documents ``lo`` to ``hi`` of a batch; ``first[i]:first[i + 1]`` are those of document ``lo + i``."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts())


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (length n + 1) of a string column; nulls count as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most ``limit`` bytes, or of one longer document."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(column: pa.Array, kinds: np.ndarray = ALNUM, fold: np.ndarray | None = LOWER) -> Iterator[Words]:
    """Word tables of a string column, chunk by chunk, in row order."""
    raw, offsets = text_buffers(column)
    for lo, hi in chunks(offsets):
        data = raw[offsets[lo] : offsets[hi]]
        data = fold[data] if fold is not None else data
        at = (offsets[lo : hi + 1] - offsets[lo]).astype(np.int64)
        n = len(data)
        kind = kinds[data].view(np.uint8)
        edge = np.ones(n + 1, dtype=bool)
        edge[1:n] = kind[1:] != kind[:-1]
        edge[at] = True
        inside = kind > 0
        starts = np.flatnonzero(inside & edge[:n])
        ends = np.flatnonzero(inside & edge[1:]) + 1
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        yield Words(lo, hi, data, starts, ends, np.searchsorted(starts, at), hashes)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether those lie in its document (else the hash is MAX_HASH)."""
    n = len(w.hashes)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, n)):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out[: n - j] += w.hashes[j:]
    whole = np.arange(n) + k <= np.repeat(w.first[1:], w.counts())
    out = mix(out ^ np.uint64(k))
    out[~whole] = MAX_HASH
    return out, whole


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of x[i:i + width] for each i, over what there is."""
    f = np.minimum if least else np.maximum
    out, span = x.copy(), 1
    while span < width:
        step = min(span, width - span)
        nxt = out.copy()
        f(out[:-step], out[step:], out=nxt[:-step]) if step < len(out) else None
        out, span = nxt, span + step
    return out


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Whether each hash is the minimum of some window of ``width`` neighbours (ties all count)."""
    least = sliding(hashes, width, True)
    # the windows that hold i start at i - width + 1 to i: the greatest of their minima is hashes[i] if i is chosen
    most = sliding(least[::-1], width, False)[::-1]
    return (most == hashes) & (hashes != MAX_HASH)


def release() -> None:
    """Gives memory that was freed back to the system; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of batches, which releases memory after each batch it gives."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            release()
        release()

    return wrapped


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches and memory that stay small."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(tidy(run), schema)
