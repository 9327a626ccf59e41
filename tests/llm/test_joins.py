"""The n-gram join, the vector codes and the resampling against brute force, with odd rows and hot groups."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import ngram_join, resampling, vector_codes

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "é😀 x"), (None, "no id"), (7, "same"), (7, "same"), (8, "a" * 50_000), (9, "!!! ???"), (10, "WORD")]


# -- n-gram join


def shingle_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def components(docs):
    own = [(i, shingle_set(t)) for i, t in docs]
    root = list(range(len(own)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(own)):
        for j in range(i):
            a, b = own[i][1], own[j][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(own):
        least[find(k)] = min([x for x in (least.get(find(k)), i) if x is not None], default=None)
    return sorted(((i, len(s), least[find(k)]) for k, (i, s) in enumerate(own)), key=str)


def joined(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("n", F.lit("clash"))
    return sorted((tuple(r) for r in ngram_join.similar_texts(df.repartition(5)).collect()), key=str)


def test_join_of_odd_rows(spark):
    got = joined(spark, ODD)
    assert got == components(ODD)
    assert joined(spark, []) == []


@pytest.mark.parametrize("size", [12, 80, 400])
def test_join_by_brute_force(spark, size):
    """Families of texts that drift apart word by word about the threshold, and copies in other case and blanks."""
    rnd = random.Random(size)
    docs = []
    for family in range(6):
        base = [f"w{rnd.randrange(50)}" for _ in range(size)]
        for k in range(12):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, max(1, size // 45), max(1, size // 25)])):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randrange(2)] = [f"x{rnd.randrange(9)}"]
            docs.append((family * 100 + k, ("  " if k % 3 else "\n").join(w).upper() if k % 4 == 0 else " ".join(w)))
    assert joined(spark, docs) == components(docs)


def test_join_of_a_large_mixed_family(spark):
    """A hot text, hundreds of near copies, and a common passage in texts that are not alike."""
    rnd = random.Random(5)
    base, passage = [f"b{i}" for i in range(60)], [f"p{i}" for i in range(30)]
    docs = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 500):
        w = list(base)
        w[rnd.randrange(60)] = f"z{rnd.randrange(40)}"
        docs.append((i, " ".join(w)))
    docs += [(i, " ".join(passage + [f"q{rnd.randrange(9999)}" for _ in range(rnd.randrange(4, 30))])) for i in range(500, 700)]
    assert joined(spark, docs) == components(docs)


@settings(max_examples=200, deadline=None)
@given(st.integers(7, 900), st.integers(0, 10**6), st.floats(0, 1))
def test_every_link_shares_a_signature(size, seed, share):
    rnd = np.random.default_rng(seed)
    both = rnd.integers(0, 1 << 63, size, dtype=np.uint64)
    most = int(0.15 * size / 0.85) + 1
    a, b = (rnd.integers(0, 1 << 63, int(most * s), dtype=np.uint64) for s in (share, 1 - share))
    x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
    if ngram_join.linked(x, y) and (len(x) != len(y) or (x != y).any()):
        keys, text = ngram_join.signatures(np.concatenate([x, y]), np.array([len(x), len(y)]))
        assert set(keys[text == 0].tolist()) & set(keys[text == 1].tolist())


def shuffled(spark, work):
    """Bytes that the stages of a piece of work wrote to the shuffle."""
    jvm, context = spark._jvm, spark.sparkContext
    none = context._gateway.new_array(jvm.double, 0)

    def stages():
        found = context._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    before = stages()
    work()
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(v for k, v in stages().items() if k not in before)


def test_signatures_are_counted_in_a_few_bytes_each(spark):
    rnd = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{x}" for x in rnd.integers(0, 10**6, 1500))) for i in range(300)]
    n = sum(len(ngram_join.signatures(s.hashes, s.counts)[0]) for s in ngram_join.sets(pa.array([t for _, t in docs])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).localCheckpoint()
    assert shuffled(spark, lambda: ngram_join.similar_texts(df).collect()) < 7 * n


def test_repeated_signatures_are_found_in_buckets():
    rnd = np.random.default_rng(4)
    for bits in (0, 1, 9, 24):
        keys = rnd.integers(0, 1 << 64, 5000, dtype=np.uint64)
        again = keys[rnd.integers(0, 5000, 700)]
        marks = type("All", (), {"value": None})()
        found = set()
        old, ngram_join._chosen = ngram_join._chosen, lambda _, batch: [(None, None, k, None) for k in batch]
        try:
            rows = pa.Table.from_batches(ngram_join._buckets(marks, bits)([[keys, again], [again, again]]))
        finally:
            ngram_join._chosen = old
        # no signature more than twice from one task
        assert sum(len(x) for x in rows["rest"].to_pylist()) == 4 * (5000 + len(set(again.tolist())))
        for bucket in set(rows["bucket"].to_pylist()):
            found |= set(ngram_join._repeated(bits)(rows.filter(pc.equal(rows["bucket"], bucket)))["key"].to_numpy().view(np.uint64).tolist())
        assert found == set(ngram_join.shortened(again, bits).tolist())


def test_first_of_each_shingle_of_a_text():
    rnd = np.random.default_rng(5)
    for most in (3, 500, 1 << 62):
        doc = np.sort(rnd.integers(0, 40, 3000))
        grams = rnd.integers(0, most, 3000).astype(np.uint64)
        seen, want = set(), []
        for pair in zip(grams.tolist(), doc.tolist(), strict=True):
            want.append(pair not in seen)
            seen.add(pair)
        assert ngram_join.first_seen(grams, doc).tolist() == want


def test_packs_of_groups_by_brute_force():
    """Groups of one block and of two, sketches of two lengths, classes that links put together."""
    rnd = np.random.default_rng(6)
    texts = []
    for _ in range(6):
        base = rnd.integers(0, 1 << 31, 1010).astype(np.int32)
        for _ in range(8):
            w = np.concatenate([base, rnd.integers(0, 1 << 31, rnd.integers(0, 60)).astype(np.int32)])
            w[rnd.integers(0, len(w), rnd.integers(0, 40))] = 7
            texts.append(w)
    own = [ngram_join.word_set(w) for w in texts]
    odd = [ngram_join.parities(x, np.array([len(x)]))[0] for x in own]
    assert len({len(x) for x in odd}) == 2
    rows, near, links = [], set(), set()
    for key in range(30):
        members = rnd.choice(len(texts), rnd.integers(2, 20), replace=False).tolist()
        blocks = {m: key % 2 * int(rnd.integers(0, 2)) for m in members}
        rows += [{"key": key, "i": 0, "j": key % 2, "block": blocks[m], "fp": m, "root": m // 2, "n": len(own[m]), "odd": odd[m], "words": texts[m], "pack": 0} for m in members]
        for a in members:
            for b in members:
                if a // 2 != b // 2 and (key % 2 == 0 or blocks[a] != blocks[b]):
                    if ngram_join.linked(own[a], own[b]):
                        links.add((a, b))
                        near.update([(key, a), (key, b)])
    table = pa.Table.from_pylist(rows)
    got = ngram_join.near(table)
    assert "pack" not in got.column_names and near <= set(zip(got["key"].to_pylist(), got["fp"].to_pylist(), strict=True))
    assert got.num_rows < len(rows)
    made = {tuple(r.values()) for r in ngram_join.settle(table).to_pylist()}
    assert made and made <= links

    def classes(pairs):
        root = [m // 2 for m in range(len(texts))]
        for a, b in pairs:
            root = [root[a] if r == root[b] else r for r in root]
        return len(set(root)), {frozenset(k for k, r in enumerate(root) if r == x) for x in root}

    assert classes(made) == classes(links)


# -- vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    rows = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0], r[1]))
    q = np.array([[math.floor(1024 * x) for x in v] for _, v, _ in rows], dtype=object)
    width = q.shape[1] // parts
    books = [[list(x[p * width : (p + 1) * width]) for x in q[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for k in range(rounds + 1):
        found = [[near(p, x[p * width : (p + 1) * width]) for p in range(parts)] for x in q]
        for p in range(parts) if k < rounds else ():
            for e in range(len(books[p])):
                own = [x[p * width : (p + 1) * width] for x, f in zip(q, found, strict=True) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for (i, _, _), f in zip(rows, found, strict=True)]
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def coded(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit(1)).withColumn("q", F.lit("clash"))
    got, books = vector_codes.vector_codes(df.repartition(3), **more)
    return sorted((r.vec_id, r.code.hex(), r.error) for r in got.collect()), books


@pytest.mark.parametrize(("n", "entries", "scale"), [(300, 256, 1.0), (120, 8, 0.004), (90, 16, 12_000.0), (5, 256, 1.0)])
def test_codes_by_brute_force(spark, n, entries, scale):
    """Many ties (small scale), exact integers beyond doubles (large scale), fewer vectors than entries, equal vectors."""
    rnd = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(x)) for x in rnd.normal(0, scale, 8).clip(-16_000, 16_000)], int(i % 3)) for i in rnd.permutation(n)]
    rows += [(i + n, rows[i][1], None) for i in range(3)]
    got, books = coded(spark, rows, entries=entries)
    want, digest = brute_codes(rows, entries=entries)
    assert got == sorted(want) and books.digest() == digest


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [1.0, None], 1), (4, [1.0, nan], 1), (5, [inf, 1.0], 1), (6, [1.0, 2.0, 3.0], None), (7, [1.0, 2.0, 3.0], None), (7, [1.0, 2.0, 3.0], 2), (8, [1.0], 1), (9, [1e30, 0.0, 0.0], 1)]
    got, books = coded(spark, rows)
    assert [r[0] for r in got] == [6, 7, 7] and books.entries.shape == (4, 3, 1) and {r[1] for r in got} == {"00000000"}
    assert coded(spark, [])[0] == []


def test_search_compares_part_of_the_entries():
    rnd = np.random.default_rng(1)
    middle = rnd.integers(-5000, 5000, (40, 4))
    x = middle[rnd.integers(0, 40, 4000)] + rnd.integers(-60, 60, (4000, 4))
    books = vector_codes.Books.of(x[None, :256].copy())
    start, _, _ = books.nearest(0, x, np.zeros(len(x), np.uint8))
    at, d, compared = books.nearest(0, x, start.astype(np.uint8))
    all_d = vector_codes.squared(x, books.entries[0])
    assert (at == all_d.argmin(axis=1)).all() and (d == all_d.min(axis=1)).all() and compared < all_d.size / 2


# -- resampling


def brute_resample(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    own, other = [(i, *features(t)) for i, t in docs], [b for t in target for b in features(t)[1]]
    s = np.bincount([b for _, _, f in own for b in f], minlength=buckets)
    t = np.bincount(other, minlength=buckets)
    gain = np.floor(1000 * np.log((t + 1.0) * (s.sum() + buckets) / ((s + 1.0) * (t.sum() + buckets)))).astype(int)
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = int(gain[f].sum()) if f else 0
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    drawn = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {k: r for k, r in enumerate(drawn[: percent * len(drawn) // 100], 1)}
    return sorted((r[0], r[2], r[3], r[4]) for r in rows if r[0] is not None), [(k, r[0], r[4]) for k, r in drawn.items()]


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 35), (1, 100)])
def test_resampling_by_brute_force(spark, longest, percent):
    rnd = random.Random(longest)
    vocabulary = [f"w{i}" for i in range(40)] + ["Éa", "日本", "Z9"]
    docs = [(i, "; ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 3, 19, 20, 25, 60])))) for i in range(200)] + [(500, None), (501, "."), (None, "a " * 30)]
    docs += [docs[7]] * 40
    target = [" ".join(rnd.choice(vocabulary[:9]) for _ in range(50)) for _ in range(5)] + [None]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bucket", F.lit("clash")).withColumn("copies", F.lit(9))
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df.repartition(4), bench, longest=longest, percent=percent).collect()
    rows, drawn = brute_resample(docs, target, longest, percent=percent)
    assert sorted((r.id, r.n_features, r.weight, r.score) for r in got if r.id is not None) == rows
    assert sorted((r["rank"], r.id, r.score) for r in got if r["rank"] is not None) == drawn


def test_resampling_of_odd_rows(spark):
    df, none = spark.createDataFrame(ODD, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    got = resampling.resample(df, none, least_words=0).collect()
    assert len(got) == len(ODD) and sorted(r["rank"] for r in got if r["rank"]) == [1]
    assert {r.weight for r in got if r.id in (1, 2, 3)} == {0}
    assert resampling.resample(none, df).collect() == []
