"""Script segments, symbols, the loop and archives on literal fixtures, with empty and odd input."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from quillspark.functions import particles, placeholders, responses
from quillspark.functions.places import found, replaced
from quillspark.operators import intervals as I
from quillspark.operators import items as M
from quillspark.operators import phases as H
from quillspark.operators import providers
from quillspark.sources import exchange as E
from quillspark.sources import script, segments, symbols
from quillspark.streaming.progress import VersionedTable


def lines(spark, text):
    return script.logical_lines(spark.createDataFrame([("d", text), ("none", None), ("empty", "")], "document_id string, text string"))


def test_segments_lie_where_they_say(spark):
    text = '@F\n#DIMS 表 = "赤/1/青"\nPRINTL 薬 %NAME:1% 水\n  ;注 "x"\nX = "文%A%字"\r\nSPLIT_STRING(表:0, "/", 部)\nCALL F(GETNUM(ITEM, 部:0), TOINT(部:1))\nPRINTDATA\nDATA <b>太</b>字\nENDDATA\nDATA 外'
    own = lines(spark, text)
    got = segments.segments(own, splits=symbols.split_lookups(own)).collect()
    assert all(text[r.start : r.start + r.length] == r.text for r in got)
    assert {(r.segment_type, r.text) for r in got} == {("split-lookup-key", "赤"), ("directive-string", "青"), ("print-tail-fragment", "薬"), ("print-tail-fragment", "水"), ("quoted-string-fragment", "文"), ("quoted-string-fragment", "字"), ("data-data-markup", "太"), ("data-data-markup", "字")}


def test_values_of_variables():
    known = symbols.values_of([("A", '"x"'), ("B", 'A ? A # "y"'), ("C", 'B + "-" + B'), ("D", "D"), ("E", "1 + 2"), ("F", " ")])
    assert {k: {*v} for k, v in known.items()} == {"a": {"x"}, "b": {"x", "y"}, "c": {"x-x", "x-y", "y-x", "y-y"}}
    many = [("A", f'"{i}"') for i in range(40)] + [("B", "A + A")]
    assert [*symbols.values_of([("A", '"b"'), ("A", '"a"'), ("B", 'A + "!"')])["b"]] == ["b!", "a!"]
    assert len(symbols.values_of(many)["a"]) == 40 and len(symbols.values_of(many)["b"]) >= symbols.VALUES


def test_places_of_matches(spark):
    rows = spark.createDataFrame([("a1b22",), ("",), (None,), ("9" * 3,), ("é1😀2",), (" ".join("1" * 700),)], "t string")
    got = rows.select("t", found(F.col("t"), "[0-9]+").alias("f"), replaced(F.col("t"), "[0-9]+", lambda m: F.concat(F.lit("<"), m, F.lit(">"))).alias("r")).collect()
    assert [[(x.start, x.length) for x in r.f] for r in got[:5]] == [[(1, 1), (3, 2)], [], [], [(0, 3)], [(1, 1), (3, 1)]]
    assert [x.start for x in got[5].f] == list(range(0, 1400, 2)) and got[4].r == "é<1>😀<2>" and got[2].r is None


def test_particles_of_odd_texts(spark):
    rows = spark.createDataFrame([(None,), ("",), ("%%",), ("%조사처리(A)%",), ("서울는 %A% 서울는",)], "t string")
    assert [r.t for r in particles.rewritten(rows, "t").collect()] == [None, "", "%%", "%조사처리(A)%", "서울은 %A% 서울은"]


def test_protection_by_order_of_patterns():
    # braces come before symbol references, which then cannot take what holds them
    text, taken = placeholders.protect_text("CFLAG:{A} CFLAG:x [1] \\n%a%")
    assert taken == ["{A}", "CFLAG:x", "[1]", "\\n", "%a%"] and text == "CFLAG:__PH0__ __PH1__ __PH2__ __PH3____PH4__"


def test_ranges_inside_others(spark):
    outer = spark.createDataFrame([("d", 0, 5000), ("d", 9000, 10)], "k string, start int, length int")
    own = spark.createDataFrame([("d", 4096, 4), ("d", 4998, 4), ("d", 9000, 10), ("e", 1, 1)], "k string, start int, length int")
    assert sorted((r.start, r.length) for r in I.inside(own, outer, "k", 64).collect()) == [(4096, 4), (9000, 10)]
    assert sorted((r.k, r.start) for r in I.without_overlap(own, outer, "k", 64).collect()) == [("e", 1)]


def test_last_edit_of_a_place(spark):
    rows = spark.createDataFrame([([(0, 1, "a"), (0, 1, "b"), (2, 1, "c")],)], "x array<struct<start:int,length:int,value:string>>")
    assert [v.value for v in rows.select(I.last_per_place(F.col("x")).alias("y")).first().y] == ["b", "c"]


def test_separators_and_answers():
    assert responses.separated('F(a、G(b、"c、d")、{x})、y') == 'F(a,G(b,"c、d"),{x})、y'
    assert responses.separated("(a、b") == "(a、b" and responses.separated("F)、(") == "F)、("


def test_loop_on_empty_items(spark):
    items = spark.createDataFrame([], "segment_id string, relative_path string, line_number int, original_text string, translated_text string, file_type string, segment_type string, status string")
    asked = []

    def provider(requests):
        asked.append(requests.count())
        return requests.select("segment_id", F.lit("x").alias("translated"), F.lit(None).cast("string").alias("error"))

    assert H.translated(items, provider, "ja", "ko").count() == 0 and set(asked) == {0}


def test_lexicon_files(spark, tmp_path):
    xml = "<d><entry><k_ele><keb>水</keb></k_ele><r_ele><reb>みず</reb></r_ele><sense><pos>n</pos></sense></entry><entry><r_ele><reb>あ</reb><re_pri>ichi1</re_pri></r_ele></entry></d>"
    with gzip.open(tmp_path / "l.xml.gz", "wt", encoding="utf-8") as f:
        f.write(xml)
    got = E.lexicon_terms(E.read_lexicon(spark, str(tmp_path / "l.xml.gz")), False, "x").collect()
    assert {(r.surface, r.reading, r.priority, r.kinds) for r in got} == {("水", "みず", 0, "n"), ("あ", "あ", 500, "")}


def test_versions_that_are_not_there(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "v"))
    assert store.delete(spark.range(1)) == 0 and store.clear() == 0 and store.read() is None and store.vacuum() == []
    for k in range(4):
        store.snapshot(spark.range(k + 1), ["id"])
    assert store.vacuum(2) == [1, 2] and store.read().count() == 4 and store.clear() == 5 and store.read().count() == 0


@pytest.mark.parametrize("status", ["DONE", "TRANSLATING", None])
def test_restored_states_of_nulls(spark, status):
    row = spark.createDataFrame([(status, None, None, None)], "a string, b string, c boolean, d string").select(M.restored_state(*map(F.col, "abcd")).alias("s")).first().s
    assert row.status == {"DONE": "FAILED", "TRANSLATING": "STOPPED", None: None}[status]


def test_providers_and_sources_of_hints(spark):
    providers.register("upper", lambda suffix: providers.by_batches(lambda texts: [t.upper() + suffix for t in texts]))
    requests = spark.createDataFrame([("a", "x", 0, 0)], "segment_id string, text string, batch int, attempt int")
    assert [tuple(r) for r in providers.create("UPPER", suffix="!")(requests).collect()] == [("a", "X!", None)]
    assert providers.create("same")(requests).first().translated == "x"
    with pytest.raises(ValueError, match="no provider"):
        providers.create("none")
    a, b = (spark.createDataFrame([(s, t)], "source string, target string") for s, t in (("k", "1"), ("k", "2")))
    assert [r.target for r in providers.composite(lambda _: a, lambda _: b)(requests).collect()] == ["2"]
