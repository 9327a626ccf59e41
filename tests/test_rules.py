"""Rules, choices and dictionary lines on literal fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import rules as R
from quillspark.operators import lexicon as L
from quillspark.operators import selection as S


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r.x for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def test_paths_identifiers_and_tags(spark):
    assert column(spark, ["a\\b.PNG", '@"%X%.txt"', "a b.png", "x.exe", "", None], R.looks_like_resource_path) == [True, True, False, False, False, False]
    assert column(spark, [" a b ", "  "], R.identifier_text) == ["ab", ""]
    assert column(spark, ["ab", "", "a:b"], R.identifier_failure) == [None, "blank", "invalid_character"]
    assert column(spark, [["news1", "nf07"], ["nf48"], ["nf300"], ["odd"], []], R.tag_priority, "array<string>") == [500, 152, 1, 100, 0]
    grams = {r[i:j] for r in ("勉強した", "行かない") for i in range(len(r)) for j in range(i + 2, len(r) + 1)}
    base = {g[: -len(e)] + b for g in grams for e, b in R.DEINFLECTIONS if g.endswith(e) and len(g) > len(e)}
    assert {"勉強する", "勉強す", "行かる"} <= base
    assert column(spark, ["勉強した、行かない", "abc"], lambda t: R.term_candidates(t, 2, 12)) == [sorted(x for x in grams | base if len(x) > 1), []]


def test_resolution_ladder(spark):
    rows = [("今日", ""), ("今日", "今日は"), ("今日", "오늘 today"), ("今日", "오늘"), ("123", "123")]
    df = spark.createDataFrame(rows, "o string, t string")
    got = [tuple(r.x) for r in df.select(R.resolved(F.col("t"), F.col("o"), "ja", "ko").alias("x")).collect()]
    assert got == [("FAILED", "blank"), ("FAILED", "source_language"), ("NEEDS_REVIEW", "ascii_word"), ("DONE", None), ("DONE", None)]
    items = spark.createDataFrame([("오늘", "", "PENDING"), ("hello", "", "PENDING"), ("今日", "", "PENDING"), ("hello", "x", "PENDING"), ("hello", "", "DONE")], "o string, t string, s string")
    assert [r.x for r in items.select(R.language_filter(F.col("o"), F.col("t"), F.col("s"), "ja", "ko").alias("x")).collect()] == ["reuse", "exclude", None, None, None]


def test_hint_scores(spark):
    df = spark.createDataFrame([("薬草", False, True, True, False, 0, False, "MANUAL"), ("薬草", True, False, False, False, 6000, True, "NEEDS_REVIEW")], "s string, b boolean, p boolean, r boolean, i boolean, n int, m boolean, t string")
    assert [r.x for r in df.select(R.hint_score(*(F.col(c) for c in "sbprinmt")).alias("x")).collect()] == [176, 38]


def test_free_range_choice(spark):
    span = "array<struct<text_id:int,start:int,end:int>>"
    rows = [(1, "abc", 0, 5, [(1, 0, 3)]), (1, "bc", 0, 9, [(1, 1, 3)]), (1, "b", 0, 9, [(1, 1, 2), (2, 0, 1)]), (1, "x", 3, 0, [(1, 2, 3)]), (2, "bc", 0, 1, [(1, 1, 3)])]
    df = spark.createDataFrame(rows, f"g int, source string, priority int, score int, ranges {span}")
    assert sorted(map(tuple, L.free_range_choice(df, "g").collect())) == [(1, "b"), (1, "x"), (2, "bc")]


def test_dictionary_lines(spark):
    lines = ["# dictionary", "a\\tb\tc\treplace\ton", "x\ty\treplace", "x\t \treplace\ton", "x\ty\tother\ton", "", "p\tq\tprompting\toff\r"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = L.import_dictionary(df, "line", {"replace": "replace", "prompting": "prompting"}, {"on": True, "off": False}, "# dictionary").collect()
    assert [(r.source, r.target, r.is_enabled) for r in got if not r.skipped] == [("a\tb", "c", True), ("p", "q", False)] and sum(r.skipped for r in got) == 3


def test_orders_and_replacement(spark):
    df = spark.createDataFrame([("c", "A.b"), ("a", "a.B a.b"), ("z", None)], "k string, t string")
    assert [r.k for r in S.in_order(df, "k", ["c", "a"]).collect()] == ["c", "a", "z"]
    got = {r.k: (r.t, r.changed) for r in S.replaced(df, "t", "a.b", "$1").collect()}
    assert got == {"c": ("$1", True), "a": ("$1 $1", True), "z": (None, False)}
