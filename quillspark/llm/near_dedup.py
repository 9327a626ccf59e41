"""Near-duplicate classes by Order MinHash and banded alignment.

Words are runs of 0-9, a-z and non-ASCII characters of the lower-cased text; k-mers are shingles of five words, each
labelled with its occurrence in the text, so that a text is a set of distinct labelled k-mers.  Each of ``hashes`` hash
functions picks the ``take`` labelled k-mers of smallest hash and keeps them in text order; the hash of that ordered
tuple is a bucket key, and so is each pair of neighbouring keys.  Texts that share a bucket are candidates.

A bucket first links its members to its least member only, so that groups of near copies cost one link a member; the
finer buckets give members of a mixed bucket another centre.  Candidates are verified by aligning the two shingle
sequences within a band: similarity = matched / (n + m - matched), matched being the longest common chain of labelled
k-mers in both orders.  The band is the largest drift that a similarity of the threshold allows, so it excludes no
alignment that could pass.  Each text is verified against its most frequent centre first.  Buckets whose members are
then of several classes are settled: all pairs of members of different classes are compared (large buckets by pairs of
blocks), first by a parity sketch of the shingles, which bounds the similarity from above, then by alignment.  So two
texts that share a bucket end in one class or have been found too different.  Classes are the connected components
(large-star, small-star).

Short texts (up to ``SHORT`` shingles) have exact keys besides: similar texts share one of the n - ceil(0.8 n) + 1
labelled k-mers that come first by (number of short texts that have it, hash).

Equal texts are one class from the start and take part once.  The chance that two longer texts of similarity s share no
key is about (1 - s^take)^hashes: 0.0002 at s = 0.8 with the defaults; if one has at most 40 shingles, none is missed.

Defined results: a null text is a class of its own; equal texts (empty ones too) are one class; texts of one to four
words have one shingle, the whole text; other texts without a word only match equal texts; repeated rows are members
like any others; the class id is the least document id of the class (null if all are null).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _words as W
from quillspark.llm._shared import Workspace, membership, positional, salted_join
from quillspark.llm.decontamination import LOWER_WORDS

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 16
TAKE = 4
#: Partners of texts of 40 shingles have 50 at most.
SHORT = 50
#: Bits of a parity sketch; members and shingles of a block of a bucket, about.
PARITY_BITS = 1024
BLOCK_MEMBERS = 4096
BLOCK_SHINGLES = 4_000_000


def labelled(grams: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes of (gram, its occurrence in the document), for grams in text order, document by document."""
    key = W.mix(grams ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), dtype=bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    at = np.arange(len(key))
    first = np.maximum.accumulate(np.where(same, 0, at))
    seen = np.empty(len(key), dtype=np.uint64)
    seen[order] = at - first
    return W.mix(grams + seen * np.uint64(0xD1342543DE82EF95))


def shingles(w: W.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order, and the document of each; a text of fewer words is one shingle."""
    hashes, whole = W.grams(w, size)
    doc, n = w.doc_of(), w.counts()
    for d in np.flatnonzero((n > 0) & (n < size)).tolist():
        own = slice(int(w.first[d]), int(w.first[d]) + 1)
        joined = n[d : d + 1].astype(np.uint64)
        for k in range(w.first[d], w.first[d + 1]):
            joined = W.mix(joined + w.hashes[k : k + 1])
        hashes[own], whole[own] = joined, True
    return hashes[whole], doc[whole]


def short_labels(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """The labelled k-mers of the short documents of a chunk, document by document, and how many each document gives."""
    grams, doc = shingles(w)
    counts = np.bincount(doc, minlength=w.hi - w.lo)
    short = counts <= SHORT
    own = short[doc]
    return labelled(grams[own], doc[own]), np.where(short, counts, 0)


def sketches(w: W.Words, hashes: int = HASHES, take: int = TAKE) -> tuple[np.ndarray, np.ndarray]:
    """The number of shingles and the (documents x hashes) keys of a chunk; documents without shingles have key 0."""
    grams, doc = shingles(w)
    n_docs = w.hi - w.lo
    counts = np.bincount(doc, minlength=n_docs)
    has = np.flatnonzero(counts)
    keys = np.zeros((n_docs, hashes), dtype=np.uint64)
    if not len(has):
        return counts, keys
    labels = labelled(grams, doc)
    first = np.concatenate([[0], np.cumsum(counts[has])[:-1]])
    row = np.repeat(np.arange(len(has)), counts[has])
    n = len(labels)
    for j in range(hashes):
        h = W.mix(labels ^ np.uint64((j + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(1)
        at = np.full((len(has), take), n, dtype=np.int64)
        for t in range(take):
            least = np.minimum.reduceat(h, first)
            hit = np.flatnonzero(h == least[row])
            hit = hit[h[hit] != W.MAX_HASH]
            at[row[hit], t] = hit
            h[hit] = W.MAX_HASH
        at.sort(axis=1)
        picked = np.append(labels, np.uint64(0))[at]
        key = np.full(len(has), j + 1, dtype=np.uint64)
        for t in range(take):
            key = W.mix(key * np.uint64(0x9FB21C651E98DF25) + picked[:, t])
        keys[has, j] = key
    return counts, keys


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column, n = batch.column("text"), batch.num_rows
        counts, keys = np.zeros(n, np.int64), np.zeros((n, HASHES), np.uint64)
        labels, sizes = [np.zeros(0, np.uint64)], np.zeros(n, np.int64)
        for w in W.words(column):
            counts[w.lo : w.hi], keys[w.lo : w.hi] = sketches(w)
            own, sizes[w.lo : w.hi] = short_labels(w)
            labels.append(own)
        offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, HASHES, 0))])
        flat = pa.array(keys[counts > 0].reshape(-1).view(np.int64), pa.int64())
        short = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(labels).view(np.int64), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("fp"), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), short], ["id", "fp", "n", "keys", "labels"])


def prefix_keys(texts: DataFrame, space: Workspace) -> DataFrame:
    """(fp, n, key) of the rarest labelled k-mers of the short texts (fp, n, labels), as many as one must be shared."""
    each = texts.where("size(labels) > 0").select("fp", "n", F.explode("labels").alias("label"))
    counts = space.save(each.groupBy("label").agg(F.count("*").alias("texts")).where("texts > 1"), "labels")
    found = salted_join(each, counts, "label", F.col("fp"), counts=counts.select("label", F.col("texts").alias("n")))
    common = found.groupBy("fp", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "label"))).alias("common"))
    # k-mers of one text come first and link nothing
    left = F.col("n") - F.ceil(F.col("n") * THRESHOLD - 1e-9) + 1 - (F.col("n") - F.size("common"))
    first = F.slice("common", 1, F.greatest(left, F.lit(0)).cast("int"))
    return common.select("fp", "n", F.explode(first).alias("k")).select("fp", "n", F.xxhash64(F.lit("prefix"), "k.label").alias("key"))


def _word_arrays(bitmap):
    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            batch = batch.filter(pa.array(bitmap.value.has(h)))
            parts, sizes = [np.zeros(0, np.int32)], []
            for w in W.words(batch.column("text")):
                parts.append(w.hashes.astype(np.uint32).view(np.int32))
                sizes.append(w.counts())
            offsets = np.concatenate([np.zeros(1, np.int64), *sizes]).cumsum()
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts)))], ["fp", "words"])

    return arrays


def _array_shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    size = min(size, len(words))
    x = words.view(np.uint32).astype(np.uint64)
    out = np.zeros(len(x) - size + 1, dtype=np.uint64)
    for j in range(size):
        out = W.mix(out * np.uint64(0x9FB21C651E98DF25) + x[j : len(x) - size + 1 + j])
    return labelled(out, np.zeros(len(out), np.int64))


def aligned_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Similarity of two int32 word arrays by banded alignment of their shingles; 0 as soon as it must be lower."""
    if not len(a) or not len(b) or (min(len(a), len(b)) < SHINGLE and len(a) != len(b)):
        return 0.0
    x, y = _array_shingles(a), _array_shingles(b)
    n, m = len(x), len(y)
    need = threshold * (n + m) / (1 + threshold) - 1e-9
    if min(n, m) < need:
        return 0.0
    band = int((n + m) * (1 - threshold) / (1 + threshold)) + 1
    _, at, to = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    near = np.abs(at - to) <= band
    at, to = at[near], to[near]
    if len(at) < need:
        return 0.0
    to = to[np.argsort(at)]
    matched = len(to)
    if (np.diff(to) < 0).any():
        tails: list[int] = []
        for v in to.tolist():
            k = bisect_left(tails, v)
            tails[k : k + 1] = [v]
        matched = len(tails)
    return matched / (n + m - matched)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("words"), batch.column("words_c")
        keep = []
        for i in range(batch.num_rows):
            x, y = (v[i].values.to_numpy(zero_copy_only=False) for v in (a, b))
            keep.append(aligned_similarity(x, y) >= THRESHOLD)
        out = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([out.column("fp"), out.column("c")], ["fp", "c"])


def parities(grams: list[np.ndarray]) -> np.ndarray:
    """Sketches whose bits are the parities of hashed k-mers: two of them differ in at most as many bits as k-mers."""
    out = np.zeros((len(grams), PARITY_BITS // 64), dtype=np.uint64)
    for i, g in enumerate(grams):
        odd = np.bincount((g & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
        out[i] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    return out


def settle(table: pa.Table) -> pa.Table:
    """Links of similar members between the classes of a bucket, or of two blocks of it; all pairs are compared."""
    fps, blocks = table.column("fp").combine_chunks(), table.column("block").to_numpy()
    words = [x.values.to_numpy(zero_copy_only=False) for x in table.column("words").combine_chunks()]
    label = np.unique(np.array([x.as_py().hex() for x in table.column("root").combine_chunks()]), return_inverse=True)[1]
    grams = [_array_shingles(w) for w in words]
    n = np.array([len(g) for g in grams])
    odd = parities(grams)
    across = (blocks != blocks[0]).any()
    links = []
    for i in range(len(words) - 1):
        to = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if across:
            to = to[blocks[to] != blocks[i]]
        to = to[np.minimum(n[to], n[i]) >= THRESHOLD * np.maximum(n[to], n[i]) - 1e-9]
        # at the threshold the k-mers of one text only are (1 - threshold) / (1 + threshold) of both texts' k-mers
        to = to[np.bitwise_count(odd[to] ^ odd[i]).sum(axis=1) <= (n[to] + n[i]) * (1 - THRESHOLD) / (1 + THRESHOLD) + 1e-6]
        for j in to.tolist():
            if label[j] != label[i] and aligned_similarity(words[i], words[j]) >= THRESHOLD:
                links.append((i, j))
                label[label == label[j]] = label[i]
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return pa.Table.from_arrays([fps.take(pa.array(a)), fps.take(pa.array(b))], ["fp", "c"])


def settled(members: DataFrame, words: DataFrame, verified: Callable[[DataFrame], DataFrame], space: Workspace) -> DataFrame:
    """Links (fp, c) between classes that share a bucket, of members (key, fp, n, root)."""
    members = space.save(members, "members")
    about = members.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min(F.struct("fp", "n")).alias("x"), F.max(F.struct("fp", "n")).alias("y"), F.count("*").alias("m"), F.sum("n").alias("all_n"))
    mixed = space.save(about.where("a != b"), "mixed")
    # a pair that shares several buckets of two is aligned once
    twos = mixed.where((F.col("m") == 2) & (F.least("x.n", "y.n") >= THRESHOLD * F.greatest("x.n", "y.n") - 1e-9))
    twos = twos.select(F.col("x.fp").alias("fp"), F.col("y.fp").alias("c")).distinct()
    parts = F.ceil(F.greatest(F.col("m") / BLOCK_MEMBERS, F.col("all_n") / BLOCK_SHINGLES)).cast("int")
    own = salted_join(members, mixed.where("m > 2").select("key", parts.alias("parts")), "key", F.col("fp")).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = own.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "root")
    blocks = salted_join(own, words, "fp", F.struct("key", "i", "j")).groupBy("key", "i", "j").applyInArrow(settle, "fp binary, c binary")
    return verified(twos).union(blocks)


def connected_components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, root) of the nodes of the edges (a, b), root the least node of the component; large-star, small-star."""
    now = space.save(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    step = 0
    while True:
        # done: every node has one edge, and none of their ends has an edge of its own
        several = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        if several.union(now.select(F.col("v").alias("u")).distinct().join(now.select("u"), "u", "left_semi")).isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both, least, "u", F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = space.save(large.where("u != v").distinct(), f"{name}-large-{step}")
        # small-star: all edges now point from the greater node to the lesser
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, low, "u", F.col("v")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        step += 1
        now = space.save(small.select("e.u", "e.v").where("u != v").distinct(), f"{name}-{step}")
        space.drop(f"{name}-{step - 1}")
        space.drop(f"{name}-large-{step - 1}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, class_fp, class_id, class_size, copies) of every row: fp identifies its text (null: none), class_fp its
    class; copies are the rows of its text."""
    space = Workspace(docs.sparkSession, "near-dedup")
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("fp", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    id_type = own.schema["id"].dataType.simpleString()
    rows = space.save(own.transform(W.mapped, _sketch, f"id {id_type}, fp binary, n long, keys array<long>, labels array<long>"), "rows")
    texts = rows.where("fp is not null and n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("labels").alias("labels"), F.min("id").alias("first_id"))
    plain = texts.select("fp", "n", F.explode("keys").alias("key")).union(space.save(prefix_keys(texts, space), "prefixes"))
    finer = F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: F.xxhash64(F.element_at("keys", i + 1), F.element_at("keys", (i + 1) % HASHES + 1)))
    keys = plain.union(texts.select("fp", "n", F.explode(finer)))
    centres = space.save(keys.groupBy("key").agg(F.min(F.struct("fp", "n")).alias("least"), F.count("*").alias("members")).where("members > 1"), "centres")
    pairs = salted_join(keys, centres.select("key", "least"), "key", F.col("fp"), counts=centres.select("key", F.col("members").alias("n"))).where("fp != least.fp").select("fp", "n", F.col("least.fp").alias("c"), F.col("least.n").alias("n_c"))
    # the similarity is at most the ratio of the shingle counts
    pairs = pairs.where(F.least("n", "n_c") >= THRESHOLD * F.greatest("n", "n_c") - 1e-9)
    pairs = space.save(pairs.groupBy("fp", "c").agg(F.count("*").alias("shared")), "pairs")
    crowded = space.save(plain.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "crowded")
    shared = space.save(salted_join(plain, crowded.select("key"), "key", F.col("fp"), counts=crowded), "shared")
    wanted = space.save(shared.select("fp").distinct(), "wanted")
    bitmap = membership(wanted, F.xxhash64("fp"))
    likely = own.where("fp is not null").select("fp", "text", F.xxhash64("fp").alias("h"))
    likely = likely.transform(W.mapped, _word_arrays(docs.sparkSession.sparkContext.broadcast(bitmap)), "fp binary, words array<int>")
    words = space.save(likely.groupBy("fp").agg(F.first("words").alias("words")).join(wanted, "fp", "left_semi"), "words")

    def verified(some: DataFrame) -> DataFrame:
        full = salted_join(some.join(words, "fp"), words.select(F.col("fp").alias("c"), F.col("words").alias("words_c")), "c", F.col("fp"))
        return full.transform(W.mapped, _verify, "fp binary, c binary")

    best = pairs.groupBy("fp").agg(F.max(F.struct("shared", "c")).alias("best")).select("fp", F.col("best.c").alias("c"))
    links = space.save(verified(best), "links")
    roots = connected_components(links.select(F.col("fp").alias("a"), F.col("c").alias("b")), space, "first")
    members = salted_join(shared, roots.withColumnRenamed("node", "fp"), "fp", F.col("key"), "left").withColumn("root", F.coalesce("root", "fp"))
    links = links.union(space.save(settled(members, words, verified, space), "settled"))
    roots = connected_components(links.select(F.col("fp").alias("a"), F.col("c").alias("b")), space, "all")
    members = rows.where("fp is not null").groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    members = members.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class_fp", F.coalesce("root", "fp"))
    classes = members.groupBy("class_fp").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size")).where("class_size > 1")
    named = salted_join(members, classes, "class_fp", F.col("fp")).select("fp", "class_fp", "class_id", "class_size", "copies")
    named = space.save(named, "classes")
    space.keep("rows", "classes")
    out = salted_join(rows.select("id", "fp"), named, "fp", F.monotonically_increasing_id(), "left", named.select("fp", F.col("copies").alias("n")))
    alone = F.col("class_size").isNull()
    return out.select(
        "id",
        "fp",
        F.coalesce("class_fp", "fp").alias("class_fp"),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents less all but one of each class: the row of least id (and, of equal ids, of least text hash)."""
    plain, name = positional(docs)
    key, text = name[id_col], name[text_col]
    space = Workspace(docs.sparkSession, "keep-one")
    marked = space.save(near_duplicates(plain, key, text).where("class_size > 1").select("id", "fp", "class_fp", "copies").distinct(), "marked")
    first = marked.groupBy("class_fp").agg(F.min(F.struct("id", "fp")).alias("kept"))
    stays = first.select(F.col("kept.fp").alias("own_fp"), F.col("kept.id").alias("kept_id"))
    flags = marked.select(F.col("fp").alias("own_fp")).distinct().join(stays, "own_fp", "left").select("own_fp", F.struct("kept_id", F.col("kept_id").isNotNull().alias("stays")).alias("flag"))
    own = plain.withColumn("own_fp", F.unhex(F.md5(F.encode(text, "UTF-8"))))
    out = salted_join(own, space.save(flags, "flags"), "own_fp", F.xxhash64(key), "left", marked.select(F.col("fp").alias("own_fp"), F.col("copies").alias("n")).distinct())
    single = out.where("flag is null").select(*plain.columns)
    # repeated rows of the kept document are one document
    kept = out.where(F.col("flag.stays") & F.col(key).eqNullSafe(F.col("flag.kept_id"))).dropDuplicates(["own_fp"]).select(*plain.columns)
    return single.unionByName(kept).toDF(*docs.columns)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "class_id", "class_size")


#: Classes by all pairs that share a labelled shingle; a shared chain is a shared set where copies keep their order.
OP10_SQL = f"""
WITH RECURSIVE x AS (SELECT text, min(doc_id) AS first, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text),
t AS (SELECT row_number() OVER (ORDER BY first, text) AS t, text, first, copies, {LOWER_WORDS} AS w FROM x),
g AS (SELECT t, i, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS g FROM t, unnest(generate_series(1, greatest(1, len(w) - 4))) s(i) WHERE len(w) > 0),
k AS (SELECT t, g, row_number() OVER (PARTITION BY t, g ORDER BY i) AS o FROM g),
n AS (SELECT t, count(*) AS n FROM k GROUP BY t),
p AS (SELECT a.t AS a, b.t AS b, count(*) AS c FROM k a JOIN k b ON a.g = b.g AND a.o = b.o AND a.t < b.t GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.t = a JOIN n y ON y.t = b WHERE 9 * c >= 4 * (x.n + y.n)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT t, t AS r FROM t UNION SELECT b, r FROM reach JOIN both_ways ON a = reach.t),
m AS (SELECT t, min(r) AS c FROM reach GROUP BY t),
c AS (SELECT c, min(first) AS class_id, sum(copies) AS class_size FROM m JOIN t USING (t) GROUP BY c)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, CAST(coalesce(class_size, 1) AS BIGINT) AS class_size
FROM documents d LEFT JOIN t ON d.text = t.text LEFT JOIN m USING (t) LEFT JOIN c USING (c)
"""
