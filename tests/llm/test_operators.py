"""Each operator against brute force on small fixtures, with nulls, empty and long texts, ties and clashing names."""

from __future__ import annotations

import collections
import gzip
import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from quillspark.llm import decontamination, importance, language_id, near_dedup, pieces, pii, quality_rules, queries, sharding, suffix_dedup, warc
from quillspark.llm._shared import Workspace
from tests.oracle import differences

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "é😀 x"), (None, "no id"), (7, "same"), (7, "same"), (8, "a" * 50_000), (9, "!!! ???")]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("n_words", F.lit("clash")).withColumn("spans", F.lit(1)) if extra else df


def words(rnd, n, letters="abcdefg"):
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 6))) for _ in range(n)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, name):
    assert not differences(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)[:3]


def test_every_operator_takes_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert language_id.predict(docs, language_id.fit(docs, "lang", "text", "doc_id")).collect() == []
    assert quality_rules.cascade(docs).collect() == []
    assert sharding.external_shuffle(docs).collect() == []
    assert decontamination.decontaminate(docs, bench).collect() == []
    assert importance.keep_good(docs, labels).collect() == []
    assert suffix_dedup.remove_repeats(docs).collect() == []
    assert pieces.encode(docs).collect() == []
    assert pii.personal_data(docs).collect() == []
    assert near_dedup.keep_one(docs).collect() == []
    files = warc.write_monolithic(warc.with_revisits(pages), "file:///tmp/none")
    assert warc.read_records(spark, files).collect() == []


def test_every_operator_takes_odd_rows(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(4, 1, 0), (5, None, None), (9, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "word"), (None, None), (2, "")], "item_id long, text string")
    tagged = docs.withColumn("lang", F.when(F.col("doc_id") == 4, "en"))
    n = len(ODD)
    found = {r.doc_id: r.lang_pred for r in language_id.predict(tagged, language_id.fit(tagged, "lang", "text", "doc_id")).collect()}
    assert found[1] == found[2] == found[9] == "und" and found[4] == "en"
    assert quality_rules.cascade(docs).count() == n
    assert sorted(r.shard for r in sharding.external_shuffle(docs, shards=4).collect()) == [0, 0, 0, 1, 1, 2, 2, 2, 3, 3]
    hits = {r.doc_id: r for r in decontamination.decontaminate(docs, bench).collect()}
    assert hits[4]["items"] == ["1"] and hits[4]["n_hit"] == 1 and hits[1]["n_words"] == 0
    good = importance.keep_good(docs, labels).collect()
    assert {r.n_words for r in good} == {"clash"} and 4 in {r.doc_id for r in good}
    assert suffix_dedup.remove_repeats(docs).count() == n
    coded = pieces.encode(docs)
    assert coded.where("not lossless").count() == 0 and coded.count() == n
    assert pii.redact(docs).count() == n and pii.redact(docs).columns == docs.columns
    assert near_dedup.keep_one(docs).count() == n - 1


def test_decontamination_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "AT_ONCE", 2)
    rnd = random.Random(1)
    items = [(i, " ".join(words(rnd, k))) for i, k in enumerate([40, 40, 13, 14, 12, 5, 1, 0])]
    docs = []
    for i in range(60):
        w = words(rnd, rnd.randint(0, 60))
        item = rnd.choice(items)[1].split()
        if item and rnd.random() < 0.7:
            a = rnd.randrange(len(item))
            w[len(w) // 2 : len(w) // 2] = item[a : a + rnd.randint(8, 40)]
        docs.append((i, " ".join(w).upper() if i % 2 else "; ".join(w)))
    expected = {}
    for i, text in docs:
        w, hit, which = decontamination.split_words(text), set(), set()
        for item, t in items:
            own = decontamination.split_words(t)
            k = min(13, len(own))
            windows = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)} if own else set()
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    hit |= set(range(j, j + k))
                    which.add(str(item))
        expected[i] = (len(w), len(hit), sorted(which))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 300):  # one block, and several, written in between
        got = decontamination.decontaminate(frame(spark, docs), bench, block_bytes=block).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in got} == expected


def test_quality_order_does_not_change_the_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rules = quality_rules.base_rules() + quality_rules.text_rules()
    measured = quality_rules.figures(docs)
    a = measured.where(quality_rules.verdict(rules).isNull()).count()
    assert a == measured.where(quality_rules.verdict(rules[::-1]).isNull()).count() == quality_rules.cascade(docs).where("kept").count()


def test_shards_are_even_seeded_and_independent_of_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = sharding.external_shuffle(docs, bucket_bytes=50_000).select("doc_id", "shard", "slot").collect()
    b = sharding.external_shuffle(docs.repartition(5), bucket_bytes=50_000).select("doc_id", "shard", "slot").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    by = collections.defaultdict(list)
    for r in a:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert [r.doc_id for r in sorted(a, key=lambda r: (r.shard, r.slot))] != sorted(r.doc_id for r in a)


def test_buckets_are_shuffled_by_fisher_yates(spark, sf):
    """The whole result again in plain Python: canonical order, the seeded inside-out Fisher-Yates pass, the law."""
    docs, seed = spark.read.parquet(f"{sf}/documents.parquet"), sharding.SEED
    record = [F.col(c) for c in docs.columns]
    total = sum(len((r.text or "").encode()) + 1 for r in docs.collect())
    buckets = -(-total // 100_000)
    own = docs.withColumn("h", F.xxhash64(F.lit(seed), *record))
    rows = collections.defaultdict(list)
    for r in own.select("doc_id", F.pmod("h", F.lit(buckets)).alias("b"), F.xxhash64(F.lit(~seed), "h").alias("key")).collect():
        rows[r.b].append((r.key, r.doc_id))
    order = []
    for b in range(buckets):
        state = np.random.RandomState([(seed + b) >> 32, (seed + b) & 0xFFFFFFFF])

        def below(n, state=state):
            while True:
                bits = int(state.randint(0, 1 << 32, dtype=np.uint32)) >> 1
                if n & (n - 1) == 0:
                    return (n * bits) >> 31
                if bits - bits % n + (n - 1) < 1 << 31:
                    return bits % n

        places = []
        for i in range(len(rows[b])):
            j = below(i + 1)
            places.append(i)
            if j != i:
                places[i] = places[j]
            places[j] = i
        ordered = sorted(rows[b])
        order += [ordered[i][1] for i in places]
    got = sharding.external_shuffle(docs, bucket_bytes=100_000).select("doc_id", "shard", "slot").collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] == order


def test_many_equal_records_share_no_bucket(spark):
    docs = spark.createDataFrame([(1, "x" * 100)] * 5000 + [(i, "y") for i in range(2, 100)], "bucket long, text string")
    got = sharding.external_shuffle(docs, shards=4, bucket_bytes=20_000)
    rows = got.collect()
    assert len(rows) == 5098 and sum(r.bucket == 1 for r in rows) == 5000
    # other rows lie between the copies everywhere
    assert len({(r.shard, r.slot // 200) for r in rows if r.bucket != 1}) > 15


def test_language_held_out_accuracy(spark, sf):
    got = queries.QUERIES["op1_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()


def test_kernel_counts_shared_grams():
    a, b = "The cat", "the bat!"
    grams = [{t.lower()[i : i + n] for n in range(1, language_id.MAX_N + 1) for i in range(len(t) - n + 1)} for t in (a, b)]
    x = language_id.presence([a, b])
    assert x.sum(axis=1).tolist() == [len(g) for g in grams]
    assert (x[0] & x[1]).sum() == len(grams[0] & grams[1])


def test_languages_by_exact_kernels(spark, sf):
    """The model again without hashing: n-gram sets, Nyström landmarks and ridge regression in plain linear algebra."""
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect() if r.lang and language_id.has_letter(r.text)]
    train, test = docs[::2][:60], docs[1::2][:40]
    grams = {r.doc_id: {r.text.lower()[i : i + n] for n in range(1, language_id.MAX_N + 1) for i in range(len(r.text.lower()) - n + 1)} for r in train + test}
    kernel = lambda a, b: len(grams[a.doc_id] & grams[b.doc_id]) / math.sqrt(len(grams[a.doc_id]) * len(grams[b.doc_id]))
    langs = sorted({r.lang for r in train})
    model = language_id.fit(spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in train], "doc_id long, text string, lang string"), "lang", "text", "doc_id", rows=60 * len(langs), landmarks=60 * len(langs))
    knm = np.array([[kernel(a, b) for b in train] for a in train])
    y = np.array([[1.0 if r.lang == x else -1.0 for x in langs] for r in train])
    weights = np.linalg.solve(knm.T @ knm + language_id.RIDGE * len(train) * knm + 1e-8 * np.eye(len(train)), knm.T @ y)
    want = np.array([[kernel(a, b) for b in train] for a in test]) @ weights
    got = model.scores([r.text for r in test])
    assert model.languages == langs and (got.argmax(axis=1) == want.argmax(axis=1)).mean() >= 0.95 and np.abs(got - want).max() < 0.3


def test_language_of_texts_of_several_megabytes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and text is not null")
    model = language_id.fit(docs, "lang", "text", "doc_id")
    for lang in model.languages:
        text = " ".join(r.text for r in docs.where(F.col("lang") == lang).collect())
        long = (text * (3_000_000 // len(text) + 1))[:3_000_000]
        assert model.languages[int(model.scores([long]).argmax())] == lang


@pytest.mark.parametrize("more", ["empty", "repeated"])
def test_languages_beside_many_rows_of_one(spark, more):
    """Rows that cannot be learned from, or that repeat, take no other language's place and change no model."""
    rnd = random.Random(3)
    rows = [(i, " ".join(words(rnd, 30, "abcdefg" if i % 2 else "tuvwxyz")), "en" if i % 2 else "de") for i in range(80)]
    few = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    plain = language_id.fit(few, "lang", "text", "doc_id")
    many = spark.range(400_000).select((F.col("id") + 1000 if more == "empty" else F.lit(0)).alias("doc_id"), F.lit("" if more == "empty" else rows[0][1]).alias("text"), F.lit("de").alias("lang"))
    model = language_id.fit(few.union(many), "lang", "text", "doc_id")
    assert model.languages == plain.languages == ["de", "en"] and (model.weights == plain.weights).all()


def test_labels_beside_many_repeats(spark):
    labels = spark.range(400).select("id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    many = spark.range(2_000_000).select(F.lit(7).cast("long").alias("id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    bad = spark.range(1000, 200_000).select("id", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    drawn = [importance.labelled_sample(x.withColumnRenamed("id", "doc_id"), "doc_id", 300, Workspace(spark, "test")).collect() for x in (labels, labels.union(many).union(bad))]
    assert len(drawn[0]) == 300 and sorted(drawn[0]) == sorted(drawn[1])


def test_importance_by_brute_force(spark):
    """Counts, log ratios and sums of hashed 1- and 2-grams again, word by word."""
    rnd = random.Random(8)
    docs = [(i, " ".join(words(rnd, rnd.randint(1, 40), "abc" if i % 2 else "xyz")) + ("!" if i % 3 else "")) for i in range(60)] + [(100, None), (101, ""), (102, docs_text := "abc abc"), (103, docs_text)]
    labels = [(i, i % 2, 0) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = importance.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    drawn = importance.labelled_sample(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "doc_id", 20_000, Workspace(spark, "test"))
    sample = {r["__id"]: r.held for r in drawn.collect()}
    assert sorted(sample) == [i for i, good, _ in labels if good]
    cut = {}

    def buckets(text):
        out = []
        tokens = re.findall(r"[a-z]+|[!-/:-@\[-`{-~]+", (text or "").lower())
        for gram in [(t,) for t in tokens] + list(zip(tokens, tokens[1:], strict=False)):
            key = " ".join(gram)
            if key not in cut:
                got = [b.tolist() for _, _, b, _ in importance.features(pa.array([key]))][0]
                cut[key] = got[-1] if len(gram) == 2 else got[0]
            out.append(cut[key])
        return out

    raw, target = collections.Counter(), collections.Counter()
    for i, t in docs:
        raw.update(buckets(t))
        if sample.get(i) is False:
            target.update(buckets(t))
    scale = sum(target.values()) / sum(raw.values())
    ratio = {b: math.log((target[b] + importance.SMOOTHING) / (raw[b] * scale + importance.SMOOTHING)) for b in raw}
    want = {i: sum(ratio[b] for b in buckets(t)) if buckets(t) else None for i, t in docs}
    held = [want[i] for i, _ in docs if sample.get(i)]
    got = {r.doc_id: r.importance for r in importance.score(df, model).collect()}
    assert got.keys() == want.keys() and all(got[i] is None if want[i] is None else abs(got[i] - want[i]) < 1e-9 for i in want)
    assert model.level == pytest.approx(float(np.quantile(held, importance.LOST)))


def test_importance_rejects_junk_and_keeps_prose(spark, sf):
    got = queries.QUERIES["op5_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rate = {r.quality: r.rate for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rate[1] > 0.9 and rate.get(0, 0.0) < 0.3


@pytest.mark.parametrize("k", [1, 2, 37, 999, 1000, 2000])
def test_kth_largest(spark, k):
    keys = [(float(i % 331) if i % 3 else math.sin(i),) for i in range(1000)]
    df = spark.createDataFrame(keys, "gumbel_key double")
    assert importance.kth_largest(df, k, bins=16) == sorted((x[0] for x in keys), reverse=True)[min(k, 1000) - 1]


def test_archives_round_trip(spark, tmp_path):
    texts = ["x", None, "", "é\r\n\r\nWARC/1.1\r\n\r\n", "y" * 3_000_000, "x"]
    rows = [(i, "http://h/\r\nx" if i % 2 else None, t) for i, t in enumerate(texts)] + [(None, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = warc.write_monolithic(warc.with_revisits(pages), f"file://{tmp_path}/whole").cache()
    files = warc.normalise(whole, f"file://{tmp_path}/members", 3).cache()
    got = {r.record_id: r for r in warc.read_records(spark, files).collect()}
    assert len(got) == len(rows) and sum(r.records for r in files.collect()) == len(rows)
    for i, t in enumerate(texts):
        r = got[f"<urn:x-page:{i}>"]
        assert r.payload_bytes == len((t or "").encode()) and r.payload_digest == warc.digest((t or "").encode())
        assert r.payload is None or bytes(r.payload).decode() == (t or "")
    assert got["<urn:x-page:5>"].refers_to == "<urn:x-page:0>" and got["<urn:x-page:2>"].refers_to == "<urn:x-page:1>"
    inflated = {sum(len(gzip.open(p).read()) for p in (tmp_path / d).glob("*.gz")) for d in ("whole", "members")}
    assert len(inflated) == 1


def spans_by_brute_force(texts):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        hit = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                hit[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(b, hit, strict=True) if not y)
        out.append((len(b), sum(hit), sum(1 for i, y in enumerate(hit) if y and not (i and hit[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("split", [1000, 3])
def test_suffix_dedup_by_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    rnd = random.Random(3)
    base = [" ".join(words(rnd, 150, "abcdeé")) for _ in range(5)]
    texts = []
    for _ in range(80):
        w = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = words(rnd, 1)[0]
        w = w[rnd.randrange(60) : rnd.randrange(80, 150)] if rnd.random() < 0.4 else w
        texts.append(" ".join(words(rnd, 30) * (rnd.random() < 0.3) + w))
    texts += ["a" * 1000, None, "", "b" * 199, "c" * 200, "c" * 200, "d" * 201, "xy" * 300, texts[0]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, list(enumerate(texts)), False), carry=["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == spans_by_brute_force(texts)


def test_buckets_are_cut_between_leading_tokens(monkeypatch):
    """A bucket read in small parts gives what it gives as a whole."""
    rnd = np.random.default_rng(5)
    base = rnd.integers(97, 100, 400, dtype=np.uint8)
    rows = []
    for i in range(300):
        body = np.roll(base, -int(rnd.integers(0, 3)) * 100)[:260].copy()
        body[int(rnd.integers(0, 260))] = 65 + i % 3
        rows.append(body.tobytes())
    hi = np.full(len(rows), 60)
    lo = np.zeros(len(rows), np.int64)
    order = sorted(range(len(rows)), key=lambda i: rows[i][60:76])
    column = [rows[i] for i in order]
    batch = pa.RecordBatch.from_pydict({"gram": pa.array(order, pa.int64()), "context": pa.array(order, pa.int64()), "check": pa.array(order, pa.int64()), "lo": pa.array(lo, pa.int32()), "hi": pa.array(hi, pa.int32()), "body": pa.array(column, pa.binary()), "token": pa.array([x[60:76] for x in column], pa.binary())})
    results = []
    for limit in (1 << 30, 3000):
        monkeypatch.setattr(suffix_dedup, "SORT_BYTES", limit)
        parts = [batch.slice(k, 17) for k in range(0, len(rows), 17)]
        out = pa.Table.from_batches(list(suffix_dedup._sorted_bucket(iter(parts)))).to_pydict()
        results.append(sorted(zip(out["gram"], out["near"], out["far"], strict=True)))
    assert results[0] == results[1] and results[0]


def test_multikey_order_sorts():
    rnd = np.random.default_rng(1)
    rows = [bytes(rnd.integers(0, 3, int(rnd.integers(0, 30)), dtype=np.uint8)) for _ in range(500)]
    _, keys, sizes = suffix_dedup.table([np.frombuffer(x, np.uint8) for x in rows], 32)
    assert [rows[i] for i in suffix_dedup.multikey_order(keys, sizes)] == sorted(rows)


def test_pieces_follow_the_lattice(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    v = pieces.Vocabulary.read()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids = {model.id_to_piece(i): i for i in range(259, model.get_piece_size())}

    def segmentations(s):
        if not s:
            yield ()
        for n in range(1, len(s) + 1):
            if s[:n] in ids:
                yield from ((ids[s[:n]], *r) for r in segmentations(s[n:]))

    weight = {x: math.exp(sum(v.log_weight[i] for i in x)) for x in segmentations("▁there")}
    n = 50_000
    got, counts = pieces.encode_chunk(v, np.frombuffer(b" there" * n, np.uint8), np.arange(n + 1) * 6, np.arange(n).astype(np.uint64) * np.uint64(7919))
    drawn = collections.Counter(map(tuple, np.split(got, np.cumsum(counts)[:-1])))
    assert set(drawn) <= set(weight)
    for x, w in weight.items():
        p = w / sum(weight.values())
        assert abs(drawn[x] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_pieces_take_little_memory():
    v, draw = pieces.Vocabulary.read(), random.Random(3)
    known = ["".join(draw.choices("aeiounrstlmd", k=draw.randint(2, 11))) for _ in range(60_000)]
    texts = [" ".join(draw.choices(known, k=300)).encode() for _ in range(2000)]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data, keys = np.frombuffer(b"".join(texts), np.uint8), np.arange(len(texts)).astype(np.uint64)
    pieces.W.powers(pieces.CHUNK + 1)

    def encoded(limit: int) -> list[int]:
        parts = [pieces.encode_chunk(v, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], keys[lo:hi])[0] for lo, hi in pieces.W.chunks(at, limit)]
        return np.concatenate(parts).tolist()

    few = encoded(1 << 18)
    tracemalloc.start()
    try:
        all_at_once = encoded(pieces.CHUNK)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all_at_once == few
    assert peak < 120e6


def test_pieces_are_reproducible_and_lossless(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "Hello  wörld\n\tfoo ▁x 😀 ;\r\n\x00"), (-2, None)], "doc_id long, text string"))
    a = pieces.encode(docs)
    b = pieces.encode(docs.repartition(7))
    assert sorted((r.doc_id, r.pieces) for r in a.collect()) == sorted((r.doc_id, r.pieces) for r in b.collect())
    odd = spark.createDataFrame([([None, 5, -1, 10**9],), (None,), ([],), ([int(pieces.Vocabulary.read().byte_id[0xE3])],)], "pieces array<int>")
    assert [r.text is None for r in pieces.decode(odd).collect()] == [False, True, False, False]
    back = pieces.decode(a.withColumnRenamed("text", "was"))
    assert back.where("not was <=> text").count() == 0


def base_by_brute_force(text):
    out = []
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for i, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text or ""):
            d = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            doubled = [(x * 2 - 9 * (x > 4)) if j % 2 else x for j, x in enumerate(reversed(d))]
            if kind == "card" and (not 14 <= len(d) <= 19 or sum(doubled) % 10) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), i, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans_by_brute_force(spark, sf):
    odd = ["a@b.c_d@e.f", "x@y.z@q.w.e", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.4.", "4111 1111 1111 1111", "4111-1111 1111-1111", "4111  1111 1111 1111 1111", "4" * 23, "é😀 a.b@c.de 😀 1.2.3.4, +1 (555) 555-1234", "", None, "+1 555 +1 555 123 4567 8", "9" * 5000, "1 " * 3000, "a" * 20_000 + "@b.c", "01.002.0003.255", "5 4111 1111 1111 1111", " ".join(f"4012888888881881 x{i}" for i in range(700))]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(frame(spark, [(-1 - i, t) for i, t in enumerate(odd)], False))
    got = {r.doc_id: r.found for r in pii.personal_data(docs).select("doc_id", pii.span_list(pii.KINDS).alias("found")).collect()}
    assert got == {r.doc_id: base_by_brute_force(r.text) for r in docs.collect()}


def test_trusted_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"please call me at +1 555 555 12{i:02d} now") for i in range(40)] + [(100 + i, f"do call me at 555-98{i:02d}, ok") for i in range(3)] + [(200 + i, f"in the year 19{i:02d} it was") for i in range(30)]
    got = {r.doc_id: r.context for r in pii.personal_data(frame(spark, rows, False)).where("size(context) > 0").collect()}
    assert set(got) == {100, 101, 102}
    text = {r.doc_id: r.text for r in pii.redact(frame(spark, rows, False)).collect()}
    assert text[0] == "please call me at [phone] now" and text[100].startswith("do call me at [context]") and text[200] == rows[-30][1]


def test_unseen_identifiers_with_blanks_are_found_whole(spark):
    found = ["(555) 123-4567", "555 123 4567", "555 - 123 4567"]
    rows = [(i, f"please call me at +1 555 555 12{i:02d} now") for i in range(40)] + [(100 + i, f"do call me at {x}, ok") for i, x in enumerate(found)]
    rows += [(200, "do call me at 555-9801. 12 people"), (201, "do call me at 555 2nd floor")]
    text = {r.doc_id: r.text for r in pii.redact(frame(spark, rows, False)).collect()}
    assert [text[100 + i] for i in range(3)] == ["do call me at [context] ok"] * 3
    assert text[200] == "do call me at [context] 12 people" and text[201] == "do call me at [context] 2nd floor"


def bootstrap_by_brute_force(texts):
    """Spans of kinds context and secret, by the definition in the module's docstring, one mention at a time."""
    mentions, words = [], collections.Counter()
    for d, text in enumerate(texts):
        text = text or ""
        for w in regex.split(r"\s+", text.lower(), flags=regex.A):
            words["L1", w] += 1
            if m := regex.match(r"[^\p{L}0-9]*(\p{L}+)", w):
                words["R1", m[1]] += 1
        seeds = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base_by_brute_force(text).split(",") if x)]
        base = list(seeds)
        seeds += [(*m.span(), "secret") for m in regex.finditer(pii.SECRET, text, flags=regex.A) if not any(a < m.end() and m.start() < b for a, b, _ in base)]
        found = seeds + [(*m.span(), None) for m in regex.finditer(pii.CANDIDATE, text, flags=regex.A) if not any(a < m.end() and m.start() < b for a, b, _ in seeds)]
        for a, b, kind in found:
            value = regex.sub(r"[\p{P}\p{S}]+$", "", text[a:b].lower())
            before, after = regex.sub(r"\s+", " ", text[:a].lower(), flags=regex.A), text[b:].lower()
            l2, l1 = (regex.search(rf"(?:^| )({r'[^ ]+ ' * k}[^ ]*)$", before) for k in (2, 1))
            r1 = regex.match(r"[^\p{L}0-9]*(\p{L}+)", after)
            shape = f"hex{len(value)}" if regex.fullmatch("[0-9a-f]{32,}", value) else regex.sub("[0-9]", "9", regex.sub(r"\p{L}+", "a", value))
            own = {("S", shape)} if "9" in shape or shape.startswith("hex") else set()
            own |= {("L2", l2[1])} if l2 else set()
            own |= {("L1", l1[1])} if l1 else set()
            own |= {("R1", r1[1])} if r1 else set()
            own |= {("LR", f"{l1[1]}|{r1[1]}")} if l1 and r1 else set()
            mentions.append((d, a, b, kind, value, own))
    kinds = {}
    for *_, kind, value, own in mentions:
        for p in own:
            kinds[p, value] = kinds.get((p, value)) or kind
    weights = collections.Counter((p, m[4]) for m in mentions for p in m[5])
    induced = {p for p, n in collections.Counter(p for (p, _), k in kinds.items() if k).items() if n >= pii.LEAST_SEEDS}
    known, good = {}, set()
    for _ in range(pii.ROUNDS):
        score = {x: 1.0 if k else known.get(x[1], 0.0) for x, k in kinds.items() if x[0] in induced}
        p_of = {}
        for p in induced:
            each = [x for x in score if x[0] == p]
            n, sure = sum(weights[x] for x in each), sum(weights[x] for x in each if score[x] > 0)
            seen = 0 if p[0] == "S" else words[p[0], p[1].split(" ")[0]] if p[0] in ("L1", "R1") else n
            p_of[p] = sum(weights[x] * score[x] for x in each) / (max(seen, sure) + 1)
        good = {p for p, v in p_of.items() if v >= pii.LEAST_SCORE}
        known = {}
        for (p, value), k in kinds.items():
            if p in good and k is None:
                known[value] = max(known.get(value, 0.0), p_of[p])
    out = [set() for _ in texts]
    for d, a, b, kind, _, own in mentions:
        if kind == "secret" or kind is None and own & good:
            out[d].add((a, b, kind or "context"))
    return out


def test_bootstrapping_by_brute_force(spark, sf):
    rnd = random.Random(4)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    number = lambda: "".join(rnd.choice("0123456789") for _ in range(16))
    for i in range(120):
        w = words(rnd, 20)
        w[10:10] = [rnd.choice(["write to me at", "my card is", "call", "the year", 'api_key: "', "Version"])]
        w[11:11] = [rnd.choice([number(), f"a{i}@b{i % 9}.org", f"me{i}(at)x.org", f"+1 555 555 {1000 + i}", f"555-{1000 + i}", f"{1900 + i}", "2.0.", f"{rnd.random()}x{i:020d}", f"10.0.0.{i},", f"10.0.0.{i + 300}"])]
        texts.append(" ".join(w))
    want = bootstrap_by_brute_force(texts)
    found = pii.personal_data(frame(spark, list(enumerate(texts)), False)).collect()
    got = {r.doc_id: {(x.start, x.end, k) for k in ("context", "secret") for x in r[k]} for r in found}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(len({x for x in v if x[2] == "context"}) for v in want) > 10


def classes_by_brute_force(docs):
    grams = {}
    for i, t in docs:
        w = decontamination.split_words(t)
        grams[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else None
    root = {i: i for i in grams}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(grams)
    text = dict(docs)
    for a in ids:
        for b in ids:
            if a < b and text[a] is not None:
                x, y = grams[a], grams[b]
                if text[a] == text[b] or (x and y and len(x & y) >= 0.8 * len(x | y)):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: find(i) for i in ids}


def test_near_duplicates_by_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rnd = random.Random(2)
    for i in range(40):
        w = docs[i][1].split()
        if len(w) > 150:
            w[rnd.randrange(len(w))] = "changed"
            docs.append((10_000 + i, " ".join(w)))
    got = {r.id: r.class_id for r in near_dedup.near_duplicates(frame(spark, docs, False)).collect()}
    assert got == classes_by_brute_force(docs)
    assert near_dedup.keep_one(frame(spark, docs, False)).count() == len(set(got.values()))


def test_near_copies_of_a_hub_are_found_whatever_the_centre(spark, monkeypatch):
    rnd = random.Random(6)  # with 5, one variant shares no key with the base, as the sketches allow
    base = [f"w{j}" for j in range(100)]
    docs = [(0, " ".join(base))]
    for i in range(1, 301):
        w = list(base)
        for at in (rnd.randrange(10, 45), rnd.randrange(55, 90)):
            w[at] = f"v{i}x{at}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(f"u{i}y{j}" for j in range(60))) for i in range(5)]
    want = classes_by_brute_force(docs)
    assert len(set(want.values())) == 6
    for members in (near_dedup.BLOCK_MEMBERS, 50):  # one block, and several
        monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", members)
        assert {r.id: r.class_id for r in near_dedup.near_duplicates(frame(spark, docs, False)).collect()} == want


def test_near_copies_with_twins_are_one_class(spark):
    """300 variants of a text with four changed words, each with a twin with one change more: few are at 0.8 of the base."""
    rnd = random.Random(9)
    base, docs = [f"w{j}" for j in range(300)], []
    for i in range(300):
        w = list(base)
        for at in rnd.sample(range(5, 295), 4):
            w[at] = f"v{i}x{at}"
        docs.append((2 * i, " ".join(w)))
        w[rnd.randrange(5, 295)] = f"t{i}"
        docs.append((2 * i + 1, " ".join(w)))
    got = {r.id: r.class_id for r in near_dedup.near_duplicates(frame(spark, docs, False)).collect()}
    assert got == classes_by_brute_force(docs)


def test_short_near_copies_are_never_missed(spark):
    docs = []
    for i in range(400):
        w = [f"w{i}x{j}" for j in range((9, 13, 44)[i % 3])]
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-1]) if i % 3 == 0 else " ".join([*w[:-1], "changed"]))]
    docs += [(10_000 + i, f"one very common line of words {i}") for i in range(60)]
    got = {r.id: r.class_id for r in near_dedup.near_duplicates(frame(spark, docs, False)).collect()}
    assert all(got[2 * i + 1] == got[2 * i] == 2 * i for i in range(400)) and all(got[10_000 + i] == 10_000 + i for i in range(60))


def test_parity_sketches_bound_the_difference():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 2**63, 3000).astype(np.uint64)
    odd = near_dedup.parities([x, x[300:], x[:1], x[1:2], x[:0]])
    differ = [int(np.bitwise_count(odd[a] ^ odd[b]).sum()) for a, b in ((0, 0), (0, 1), (2, 4), (2, 3))]
    assert differ[0] == 0 and 150 < differ[1] <= 300 and differ[2] == 1 and differ[3] in (0, 2)


def test_alignment_is_order_sensitive():
    x = np.arange(200, dtype=np.int32)
    assert near_dedup.aligned_similarity(x, x) == 1.0
    assert near_dedup.aligned_similarity(x, x[:-10]) == pytest.approx(186 / 196)
    assert near_dedup.aligned_similarity(x, np.concatenate([x[100:], x[:100]])) == 0.0
    assert near_dedup.aligned_similarity(x[:3], x[:4]) == 0.0


def test_components(spark, tmp_path):
    from quillspark.llm._shared import Workspace

    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(30)] + [(500, 501)]
    got = {r.node: r.root for r in near_dedup.connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "cc"), "t").collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[101 + i] == 100 for i in range(30)) and got[501] == 500


def test_pipeline_against_its_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.Workspace(spark, "test").save(stage(spark, docs, sf), name)
        sizes.append(docs.count())
        if name == "near_duplicates":
            kept = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
            assert all(k == v for k, v in classes_by_brute_force(kept).items())
        if name == "decontamination":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert decontamination.decontaminate(docs, bench).where(decontamination.is_contaminated()).count() == 0
        if name == "personal_data":
            assert all(base_by_brute_force(r.text) == "" for r in docs.collect())
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2] and sizes[3] == sizes[4] == sizes[5]
    assert corpus_pipeline.run(spark, sf).count() == sizes[-1]


@pytest.mark.parametrize("rows", [0, len(ODD)])
def test_pipeline_takes_empty_and_odd_tables(spark, tmp_path, rows):
    import corpus_pipeline

    docs = frame(spark, ODD[:rows], False).select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 1, None), (None, 0, 0)][:rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "word"), (None, None)][:rows], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the null, the empty and the blank text have no token; "word" is a benchmark item; equal texts are one
    assert len({r.doc_id for r in got}) == len(got) and all(r.lossless for r in got) and {r.doc_id for r in got} <= {None, 5, 7, 8, 9}
