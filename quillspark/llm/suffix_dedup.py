"""Repeated passages removed by a distributed sparse suffix array.

A text is its UTF-8 bytes.  Every string of ``LENGTH`` bytes is represented by one suffix, its *anchor*: the suffix in
it whose first ``GRAM`` bytes have the least hash (the leftmost of equals).  Which suffix that is depends on the
string's bytes alone, so equal strings have equal anchors at equal distances, and only anchored suffixes need sorting.
An anchor at p stands for the strings that begin d bytes before it, lo <= d <= hi; its *context* is their union.

1. Anchors whose leading gram occurs once in the corpus are left out (counted exactly; a bounded bitmap spares rows).
2. A context that occurs twice or more (by two independent 64-bit hashes besides that of its gram) is one suffix of the
   array; all its strings are repeated.
3. Contexts that differ but share their leading gram are compared byte by byte: sampled splitters range-partition their
   suffixes by the leading token, each bucket sorts the suffixes by multikey quicksort, once by what follows the anchor
   and once by what precedes it, backwards.  Strings at distance d are equal if and only if the contexts share d bytes
   before and LENGTH - d bytes from the anchor on, which the two orders' common-prefix lengths tell.  A bucket that is
   read in parts compares its last token with the next part's first before it lets go of it; splitters fall between
   different tokens, so equal strings never lie on two sides of a boundary.
4. The leading token is the gram.  A token that more than ``SPLIT`` contexts share is replaced by longer ones: the
   distances are quartered, and all strings of distance a to b share the bytes from a before the anchor to LENGTH - b after
   it, which are the new token.  That goes on where tokens stay crowded; at a single distance the token is the whole
   string, so its contexts are equal and nothing is left to sort.  So no task holds more than SPLIT contexts of a token.
5. The strings found are united to spans by text, and the bytes that are left are hashed.

Equal texts are worked on by their MD5 as one text.  Nothing is dropped, capped or sampled.

Defined results: null and empty texts have no bytes and keep the hash of nothing; texts of less than LENGTH bytes have
no string and stay; repeated rows repeat each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _words as W
from quillspark.llm._shared import Workspace, membership, salted_join

LENGTH = 200
GRAM = 64
REACH = LENGTH - GRAM
#: Contexts of one leading token that are sorted together at most.
SPLIT = 1000
#: Bytes of contexts sorted at a time, or one leading token's.
SORT_BYTES = 12 << 20


BYTES = W.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@dataclass
class Anchors:
    """Anchors of a chunk: place, distances of their strings, document, hash of the leading gram and of the context."""

    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    doc: np.ndarray
    gram: np.ndarray
    context: np.ndarray
    check: np.ndarray
    data: np.ndarray
    sums: np.ndarray

    def window(self, begin: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hash of the bytes from begin on."""
        return (self.sums[begin + size] - self.sums[begin]) * W.powers(len(self.sums))[1][begin]


def anchors(data: np.ndarray, offsets: np.ndarray) -> Anchors:
    n = len(data)
    up, down = W.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    valid = np.zeros(n + 1, np.int32)
    long = np.diff(offsets) >= LENGTH
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(valid[:n]) > 0)
    none = np.zeros(0, np.int64)
    if not len(start):
        return Anchors(none, none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64), data, sums)
    gram = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    gram = (gram ^ (gram >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    bits = np.uint64(max(16, n.bit_length()))
    placed = ((gram >> bits) << bits) | np.arange(len(gram), dtype=np.uint64)
    least = W.sliding(placed, REACH + 1, True)
    at = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    tail = np.append(head[1:], len(at)) - 1
    p = at[head]
    hi, lo = p - start[head], p - start[tail]
    doc = np.searchsorted(offsets, p, "right") - 1
    out = Anchors(p, lo, hi, doc, W.mix(gram[p]), none.view(np.uint64), none.view(np.uint64), data, sums)
    shape = (lo * 1024 + hi).astype(np.uint64)
    begin, size = start[head], start[tail] + LENGTH - start[head]
    out.context = W.mix(out.window(begin, size) + shape * np.uint64(0x9E3779B97F4A7C15))
    # another hash of the same bytes, each byte as a random value
    other = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[data] * up[:n], out=other[1:])
    out.check = W.mix((other[begin + size] - other[begin]) * down[begin])
    return out


def chunked(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, Anchors]]:
    raw, offsets = W.text_buffers(column)
    for lo, hi in W.chunks(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        yield lo, hi, at, anchors(raw[offsets[lo] : offsets[hi]], at)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, _, a in chunked(batch.column("text")):
            gram, n = np.unique(a.gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(gram), pa.array(n)], ["gram", "n"])


def _repeated_anchors(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, at, a in chunked(batch.column("text")):
                k = np.flatnonzero(bitmap.value.has(a.gram))
                fp = batch.column("fp").take(pa.array(lo + a.doc[k]))
                place = (a.at[k] - at[a.doc[k]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([signed(a.gram[k]), signed(a.context[k]), signed(a.check[k]), fp, pa.array(place), pa.array(a.lo[k], pa.int32()), pa.array(a.hi[k], pa.int32())], ["gram", "context", "check", "fp", "at", "lo", "hi"])

    return run


def _contexts(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, a in chunked(batch.column("text")):
                k = np.flatnonzero(bitmap.value.has(a.context))
                # one of each in a chunk
                k = k[np.unique(a.context[k] ^ W.mix(a.gram[k] ^ W.mix(a.check[k])), return_index=True)[1]]
                begin, end = a.at[k] - a.hi[k], a.at[k] - a.lo[k] + LENGTH
                sizes = end - begin
                ends = np.concatenate([[0], np.cumsum(sizes)])
                flat = a.data[np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])]
                bodies = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([signed(a.gram[k]), signed(a.context[k]), signed(a.check[k]), pa.array(a.lo[k], pa.int32()), pa.array(a.hi[k], pa.int32()), bodies], ["gram", "context", "check", "lo", "hi", "body"])

    return run


def multikey_order(words: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian words, then of ``last``, by multikey quicksort: every run of rows that are equal
    so far is split by its next word, all runs of a level at once, until no run has two rows."""
    order = np.argsort(words[:, 0], kind="stable")
    run = np.concatenate([[0], np.cumsum(np.diff(words[order, 0]) != 0)]) if len(order) else order
    for level in range(1, words.shape[1] + 1):
        sizes = np.bincount(run)
        live = np.flatnonzero(sizes[run] > 1)
        if not len(live):
            break
        rows = order[live]
        key = words[rows, level] if level < words.shape[1] else last[rows]
        inner = np.lexsort((key, run[live]))
        order[live] = rows[inner]
        key, own = key[inner], run[live]
        fresh = np.zeros(len(order), np.int64)
        fresh[live[1:]] = (own[1:] == own[:-1]) & (key[1:] != key[:-1])
        run = run + np.cumsum(fresh)
        run = np.concatenate([[0], np.cumsum(np.diff(run) != 0)])
    return order


def table(parts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of bytes padded with zeros, the same as big-endian words, and their lengths."""
    sizes = np.array([len(x) for x in parts])
    out = np.zeros((len(parts), width), np.uint8)
    out[np.repeat(np.arange(len(parts)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.concatenate(parts) if len(parts) else np.zeros(0, np.uint8)
    return out, out.view(">u8").astype(np.uint64), sizes


def shared_prefix(rows: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common-prefix length of each row and the one before it in the order; -1 for the first."""
    out = np.full(len(order), -1, np.int64)
    for k in range(1, len(order), 1 << 14):
        a, b = order[k - 1 : k - 1 + (1 << 14)], order[k : k + (1 << 14)]
        differ = rows[a[: len(b)]] != rows[b]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[k : k + len(b)] = np.minimum(same, np.minimum(sizes[a[: len(b)]], sizes[b]))
    return out


def repeated_strings(bodies: list[bytes], lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance at which a context has a string that another of the contexts has too (-1: none)."""
    n = len(bodies)
    near, far = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if n < 2:
        return near, far
    raw = [np.frombuffer(x, np.uint8) for x in bodies]
    after, words, sizes = table([x[h:] for x, h in zip(raw, hi.tolist(), strict=True)], LENGTH)
    right = multikey_order(words, sizes)
    right_lcp = shared_prefix(after, sizes, right)
    group = np.empty(n, np.int64)
    group[right] = np.cumsum(right_lcp < GRAM) - 1
    before, words, sizes = table([x[:h][::-1] for x, h in zip(raw, hi.tolist(), strict=True)], REACH)
    left = multikey_order(np.column_stack([group.astype(np.uint64), words]), sizes)
    left_lcp = shared_prefix(before, sizes, left)
    left_lcp[1:][group[left[1:]] != group[left[:-1]]] = -1

    def longest(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        best = np.empty(n, np.int64)
        best[order] = np.maximum(lcp, np.append(lcp[1:], -1))
        return best

    most_left, most_right = longest(left, left_lcp), longest(right, right_lcp)
    first, last = np.maximum(lo, LENGTH - most_right), np.minimum(hi, most_left)
    for d in range(REACH + 1):
        live = np.flatnonzero((first <= d) & (d <= last))
        if len(live) < 2:
            continue
        a, b = np.empty(n, np.int64), np.empty(n, np.int64)
        a[left], b[right] = np.cumsum(left_lcp < d), np.cumsum(right_lcp < LENGTH - d)
        key = a[live] * (n + 1) + b[live]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = live[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
        far[twice] = d
        fresh = twice[near[twice] < 0]
        near[fresh] = d
    return near, far


def _sorted_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets arrive ordered by leading token; whole tokens are sorted together."""
    held: list[pa.RecordBatch] = []

    def result(rows: pa.Table) -> pa.RecordBatch:
        near, far = repeated_strings(rows["body"].to_pylist(), rows["lo"].to_numpy(), rows["hi"].to_numpy())
        keep = np.flatnonzero(near >= 0)
        some = rows.take(pa.array(keep)).combine_chunks()
        return pa.RecordBatch.from_pydict({"gram": some["gram"].combine_chunks(), "context": some["context"].combine_chunks(), "check": some["check"].combine_chunks(), "near": pa.array(near[keep], pa.int32()), "far": pa.array(far[keep], pa.int32())})

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= SORT_BYTES:
            rows = pa.Table.from_batches(held)
            lead = rows["token"]
            last = lead[len(rows) - 1]
            # the last token may go on in the next batch
            stop = len(rows) - 1
            step = 1
            while stop > 0 and lead[max(stop - step, 0)] == last:
                stop, step = max(stop - step, 0), step * 2
            while stop < len(rows) and lead[stop] != last:
                stop += 1
            while stop > 0 and lead[stop - 1] == last:
                stop -= 1
            if stop:
                yield result(rows.slice(0, stop))
            held = rows.slice(stop).to_batches()
            size = sum(x.nbytes * x.num_rows / max(rows.num_rows, 1) for x in held)
    if held:
        yield result(pa.Table.from_batches(held))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data, at, h = text.encode("utf-8"), 0, hashlib.sha256()
            for s in spans:
                h.update(data[at : s["begin"]])
                at = s["end"]
            h.update(data[at:])
            left.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(left, pa.string())], ["fp", "kept_sha256"])


def _sift(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(bitmap.value.has(h))).select(["fp", "text"])

    return run


def united(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as sorted disjoint spans that do not touch."""
    order = np.argsort(begin, kind="stable")
    begin, most = begin[order], np.maximum.accumulate(end[order])
    fresh = np.concatenate([[True], begin[1:] > most[:-1]])
    return begin[fresh], most[np.append(fresh[1:], True)]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = []
        for row in batch.column("x"):
            x = row.values
            begin, end = united(x.field("begin").to_numpy(zero_copy_only=False), x.field("end").to_numpy(zero_copy_only=False))
            spans.append([{"begin": i, "end": j} for i, j in zip(begin.tolist(), end.tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(spans, kind)], ["fp", "spans"])


def token(body: str, hi: str, a: str, b: str) -> Column:
    """The bytes that all strings of distances a to b of a context share, after the number a."""
    return F.expr(f"concat(unhex(lpad(hex({a}), 2, '0')), substring({body}, {hi} - {a} + 1, {LENGTH} - {b} + {a}))")


def parted(rows: DataFrame) -> DataFrame:
    """The contexts (lo, hi, body, a, b) for each quarter of their distances a to b that they have strings in."""

    def quarter(k: Column) -> Column:
        # of n distances, those from k * n / 4 to (k + 1) * n / 4; none of them if the two are equal
        n = F.col("b") - F.col("a") + 1
        return F.struct((F.col("a") + F.floor(k * n / 4)).cast("int").alias("a"), (F.col("a") + F.floor((k + 1) * n / 4) - 1).cast("int").alias("b"))

    ranges = F.transform(F.array(*map(F.lit, range(4))), quarter)
    own = rows.select("gram", "context", "check", F.col("lo").alias("l"), F.col("hi").alias("h"), "body", F.explode(ranges).alias("r")).where("r.a <= r.b")
    own = own.select("*", F.greatest("l", "r.a").alias("lo"), F.least("h", "r.b").alias("hi"), "r.a", "r.b").where("lo <= hi")
    cut = F.expr(f"substring(body, h - hi + 1, hi - lo + {LENGTH})")
    return own.select("gram", "context", "check", "lo", "hi", cut.alias("body"), "a", "b")


def matched(bodies: DataFrame, space: Workspace) -> DataFrame:
    """(gram, context, check, near, far): the least and greatest distance of a string that another context has too, of
    contexts with n, how many share their gram."""
    columns = ["gram", "context", "check", "lo", "hi", "body", "token"]
    rows = bodies.withColumn("a", F.lit(0)).withColumn("b", F.lit(REACH)).withColumn("token", token("body", "hi", "a", "b"))
    to_sort, alike = rows.where(F.col("n") <= SPLIT).select(columns), None
    crowded, level = rows.where(F.col("n") > SPLIT), 0
    while not crowded.isEmpty():
        level += 1
        rows = space.save(parted(crowded).withColumn("token", token("body", "hi", "a", "b")), f"suffixes-{level}")
        counts = space.save(rows.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), f"tokens-{level}")
        rows = space.save(salted_join(rows, counts, "token", F.col("context"), counts=counts), f"sized-{level}")
        whole = rows.where("a = b").select("gram", "context", "check", F.col("a").alias("near"), F.col("a").alias("far"))
        to_sort = to_sort.unionByName(rows.where((F.col("n") <= SPLIT) & (F.col("a") < F.col("b"))).select(columns))
        alike = whole if alike is None else alike.unionByName(whole)
        crowded = rows.where((F.col("n") > SPLIT) & (F.col("a") < F.col("b")))
    schema = "gram long, context long, check long, near int, far int"
    found = to_sort.repartitionByRange("token").sortWithinPartitions("token").transform(W.mapped, _sorted_bucket, schema)
    found = found if alike is None else found.union(alike)
    return found.groupBy("gram", "context", "check").agg(F.min("near").alias("near"), F.max("far").alias("far"))


def repeated_spans(own: DataFrame, space: Workspace) -> DataFrame:
    """(fp, spans) of the texts (fp, text) that hold repeated strings; spans are disjoint byte ranges."""
    spark = own.sparkSession
    share = spark.sparkContext.broadcast
    texts = own.select("text")
    key = ["gram", "context", "check"]
    grams = texts.transform(W.mapped, _gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    grams = space.save(grams, "grams")
    found = own.select("fp", "text").transform(W.mapped, _repeated_anchors(share(membership(grams, F.col("gram")))), "gram long, context long, check long, fp binary, at long, lo int, hi int")
    found = space.save(found, "anchors")
    kinds = space.save(found.groupBy(*key).agg(F.count("*").alias("n")), "kinds")
    several = kinds.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
    differing = space.save(salted_join(kinds.select(*key), several, "gram", F.col("context")).select(*key, "m"), "differing")
    bodies = texts.transform(W.mapped, _contexts(share(membership(differing, F.col("context")))), "gram long, context long, check long, lo int, hi int, body binary")
    bodies = bodies.groupBy(*key).agg(F.min(F.struct("lo", "hi", "body")).alias("x")).join(differing, key).select(*key, "x.*", F.col("m").alias("n"))
    partly = space.save(matched(space.save(bodies, "bodies"), space), "partly")
    whole = kinds.where("n > 1").select(*key, F.lit(None).cast("int").alias("near"), F.lit(None).cast("int").alias("far"))
    hits = whole.unionByName(partly.join(whole, key, "left_anti"))
    named = F.struct(*key).alias("k")
    parts = hits.select(named, "near", "far")
    covered = salted_join(found.select(named, "fp", "at", "lo", "hi"), parts, "k", F.struct("fp", "at"), counts=kinds.select(named, "n")).select(
        "fp",
        F.struct((F.col("at") - F.coalesce("far", "hi")).alias("begin"), (F.col("at") - F.coalesce("near", "lo") + LENGTH).alias("end")).alias("x"),
    )
    spans = covered.groupBy("fp").agg(F.collect_set("x").alias("x")).transform(W.mapped, _united, "fp binary, spans array<struct<begin:bigint,end:bigint>>")
    spans = space.save(spans, "spans")
    space.keep("spans")
    return spans


def remove_repeats(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The rows (columns of ``carry``) with n_bytes, spans (removed byte ranges), n_removed, n_spans, kept_sha256."""
    space = Workspace(docs.sparkSession, "suffix-dedup")
    share = docs.sparkSession.sparkContext.broadcast
    carry = docs.columns if carry is None else carry
    own = docs.select(*(F.col(f"`{c}`").alias(f"c_{k}") for k, c in enumerate(carry)), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    own = own.withColumn("fp", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    spans = repeated_spans(own, space)
    spans = spans.withColumn("n_removed", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"]))
    marked = share(membership(spans, F.xxhash64("fp")))
    some = own.select("fp", "text", F.xxhash64("fp").alias("h")).transform(W.mapped, _sift(marked), "fp binary, text string")
    # a text of which nothing is left needs no reading
    some = some.groupBy("fp").agg(F.first("text").alias("text")).join(spans.select("fp", "spans", "n_removed"), "fp").where("n_removed < octet_length(text)")
    cut = space.save(some.select("fp", "text", "spans").transform(W.mapped, _cut, "fp binary, kept_sha256 string"), "cut")
    done = space.save(spans.join(cut, "fp", "left"), "done")
    space.keep("done")
    rows = own.select(*(f"c_{k}" for k in range(len(carry))), "fp", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("own_sha256"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    return salted_join(rows, done, "fp", F.monotonically_increasing_id(), "left").select(
        *(F.col(f"c_{k}").alias(c) for k, c in enumerate(carry)),
        "n_bytes",
        F.coalesce("spans", empty).alias("spans"),
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.size(F.coalesce("spans", empty)).cast("long").alias("n_spans"),
        F.when(F.col("spans").isNull(), F.col("own_sha256")).otherwise(F.coalesce("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()))).alias("kept_sha256"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, carry=["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Bytes as hexadecimal digits, read by pieces of 1024 bytes so that no long text is scanned again and again.
OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT r, j, substr(h, 2048 * j + 1, 2446) AS h FROM d, unnest(generate_series(0, length(h) // 2048)) s(j)),
w AS (SELECT r, 1024 * j + i AS i, md5_number(substr(h, 2 * i + 1, 400)) AS m FROM x, unnest(generate_series(0, length(h) // 2 - 200)) s(i)),
c AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
t AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM w JOIN c USING (m)),
g AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM t),
s AS (SELECT r, k, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, k),
e AS (SELECT r, a, b, lag(b) OVER (PARTITION BY r ORDER BY a) AS before FROM s),
k AS (SELECT r, sum(b - a) AS n, count(*) AS m, string_agg(substr(h, 2 * coalesce(before, 0) + 1, 2 * (a - coalesce(before, 0))), '' ORDER BY a) AS head, max(b) AS last
      FROM e JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(m, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
