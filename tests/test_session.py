"""Sessions, ledgers, stacks and particles in order, against plain Python."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import intervals, phases, providers, write_back
from quillspark.streaming.session import Change, Conflict, Manifest, Session


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_commit_rewrites_what_it_touches(spark, tmp_path):
    store = Session(spark, str(tmp_path / "s"), 8)
    assert store.read("a") is None and store.vacuum() == []
    rows = spark.range(1000).select("id", F.lit("x").alias("v"))
    store.commit({"a": Change(["id"], rows), "b": Change(["id"], rows.limit(0))})
    before = store.manifest()
    store.commit({"a": Change(["id"], spark.createDataFrame([(3, "y"), (5000, "z")], "id long, v string"), spark.createDataFrame([(3,), (9,)], "id long"))})
    after = store.manifest()
    moved = [g for g in after.folders["a"] if after.folders["a"][g] != before.folders["a"].get(g)]
    assert 1 <= len(moved) <= 3 and after.folders.get("b", {}) == before.folders.get("b", {})
    got = {r.id: r.v for r in store.read("a").collect()}
    assert len(got) == 1000 and got[3] == "y" and got[5000] == "z" and 9 not in got
    assert store.read("a", 1).count() == 1000 and store.read("b").count() == 0
    old = files(tmp_path)
    assert store.vacuum(1) == [1] and len(files(tmp_path)) < len(old) and store.read("a").count() == 1000


def test_a_failed_commit_changes_nothing(spark, tmp_path):
    store = Session(spark, str(tmp_path / "s"), 4)
    rows = spark.range(10).select("id", F.lit("x").alias("v"))
    store.commit({"a": Change(["id"], rows), "b": Change(["id"], rows)})
    broken = rows.withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.commit({"a": Change(["id"], rows.withColumn("v", F.lit("y"))), "b": Change(["id"], broken)})
    assert store.numbers() == [1] and {r.v for r in store.read("a").collect()} == {"x"}
    # another writer took the number in the meantime
    with pytest.raises(Conflict):
        store._publish(Manifest(1))
    assert store.commit({"a": Change(["id"], rows)}, token=("s", 4)) == 2 and store.commit({"a": Change(["id"], rows)}, token=("s", 4)) == 2


def test_a_stream_commits_each_batch_once(spark, tmp_path):
    source = str(tmp_path / "in")
    store = Session(spark, str(tmp_path / "s"), 4)
    for k in range(2):
        spark.createDataFrame([(1, k, f"v{k}"), (2 + k, k, "w")], "id long, at long, v string").coalesce(1).write.mode("append").parquet(source)
        store.follow(spark.readStream.schema("id long, at long, v string").parquet(source), "t", ["id"], "at", str(tmp_path / "c")).awaitTermination()
    assert sorted((r.id, r.v) for r in store.read("t").collect()) == [(1, "v1"), (2, "w"), (3, "w")]


def test_a_stopped_run_goes_on(spark, tmp_path):
    ledger, asked = providers.Ledger(spark, str(tmp_path / "l")), []

    def provider(requests):
        asked.append(sorted(r.segment_id for r in requests.collect()))
        return requests.select("segment_id", F.concat(F.lit("번역"), "segment_id").alias("translated"), F.when(F.col("segment_id") == "3", "bad").alias("error"))

    items = spark.createDataFrame([(str(k), "f", k, f"原文{k}", "", "script", "print", "PENDING") for k in range(6)], "segment_id string, relative_path string, line_number int, original_text string, translated_text string, file_type string, segment_type string, status string")
    one = phases.translated(items, ledger.kept(provider, 3, lambda: len(asked) >= 1), "ja", "ko", batch_size=2, retries=0)
    assert {r.segment_id: r.status for r in one.collect()} == {"0": "DONE", "1": "DONE", **dict.fromkeys("2345", "STOPPED")}
    two = phases.translated(one.drop("reason"), ledger.kept(provider, 3), "ja", "ko", batch_size=2, retries=0)
    got = {r.segment_id: r.status for r in two.collect()}
    assert got["3"] == "FAILED" and {got[k] for k in "01245"} == {"DONE"} and sorted(sum(asked, [])) == list("012345")


def test_stacks_by_brute_force(spark):
    rnd = random.Random(2)
    rows = [(k, n * 3, f"{k}.{n}", rnd.random() < p, rnd.random() < 0.45) for k, p in (("a", 0.45), ("b", 0.2), ("c", 0.9)) for n in range(200)]
    want, stacks = {}, {}
    for k, n, v, o, c in rows:
        s = stacks.setdefault(k, [])
        want[(k, n)] = list(s)
        if c and s:
            s.pop()
        if o:
            s.append(v)
    df = spark.createDataFrame(rows, "k string, n int, v string, o boolean, c boolean").repartition(3)
    assert {(r.k, r.n): list(r.stack) for r in intervals.stack_contents(df, "k", "n", "v", "o", "c", 64).collect()} == want


def test_particles_follow_what_is_put_out(spark):
    # "을(를)" has a form only once the text before it has one
    texts = ["학교", "은(는)", "을(를)", "은 길", "으로", None, "을(를)", "abc", "은", "", "는"]
    df = spark.createDataFrame([("d", k, t) for k, t in enumerate(texts)], "k string, n int, t string")
    got = [r.t for r in write_back.led_particles(df, "k", "n", "t", F.col("n") == 7).orderBy("n").collect()]
    assert got == ["학교", "는", "을", "은 길", "로", None, "을(를)", "abc", "은", "", "는"]
