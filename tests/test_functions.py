"""Placeholders, readings and script lines on literal fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import placeholders as H
from quillspark.functions import reading as R
from quillspark.sources import script as S


def test_protect_and_restore(spark):
    texts = ["a %NAME% {X} <b>", r"\n%A\nB%", "[ 1 ] f:(x(1)) &lt;", "plain", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("p", H.protect("t"))
    out = df.withColumn("back", H.restore(F.col("p.text"), F.col("p.placeholders"))).withColumn("error", H.token_error(F.col("p.text"), F.col("p.placeholders"))).orderBy("i").collect()
    assert [r.back for r in out] == texts and all(r.error is None for r in out)
    assert out[0].p.text == "a __PH0__ __PH1__ __PH2__" and out[0].p.placeholders == ["%NAME%", "{X}", "<b>"]
    # an escape comes before a percent span, whatever the place
    assert out[1].p.placeholders == [r"\n", r"\n"]
    loose = spark.createDataFrame([("_PH0__ x __PH1_ y _PH 9_", ["A", "B"]), ("__PH1__ __PH0__", ["A", "B"]), ("__PH0__", ["A", "B"])], "t string, p array<string>")
    got = loose.select(H.restore(F.col("t"), F.col("p")).alias("r"), H.token_error(F.col("t"), F.col("p")).alias("e")).collect()
    assert got[0].r == "A x B y _PH 9_" and [r.e for r in got] == ["count", "order", "count"]


def test_han_readings(spark):
    names = spark.createDataFrame([(1, "女子"), (2, "子女"), (3, "理論"), (4, "女／女"), (5, "未知"), (6, "a子")], "k int, t string")
    readings = spark.createDataFrame([("女", "녀"), ("子", "자"), ("理", "리"), ("論", "론")], "kanji string, reading string")
    got = {r.k: r.reading for r in R.han_readings(names, "k", "t", readings).collect()}
    assert got == {1: "여자", 2: "자녀", 3: "이론", 4: "여／여"}


def test_script_lines(spark):
    text = '@START(ARG)\r\n;!;PRINTL shown\n; note CALLED(1)\nX = { 1,\n;inside\n2 }\nPRINTFORML 今日 %F(2)%\nCALL G("H(1)", K(3)) ; L(4)\n'
    docs = spark.createDataFrame([("d", text), ("e", None)], "document_id string, text string")
    lines = S.logical_lines(docs).orderBy("line_number").cache()
    rows = lines.collect()
    assert [r.line_number for r in rows] == [0, 1, 2, 3, 6, 7, 8]
    assert rows[1].code == "   PRINTL shown" and rows[3].code == "X = { 1,\n       \n2 }"
    assert all(text[r.start : r.start + len(r.code)].replace("\r", " ").replace(";!;", "   ").replace(";inside", "       ") == r.code for r in rows)
    assert {r.name for r in S.functions(lines).collect()} == {"START", "F", "G", "K"}
    shown = S.print_texts(lines).orderBy("start").collect()
    assert [r.text for r in shown] == ["shown", "今日 %F(2)%"] and all(text[r.start : r.start + r.length] == r.text for r in shown)
    listing = spark.createDataFrame([("CSV/item.csv", "csv"), ("CSV/_x.csv", "csv"), ("CSV/Tag@2.csv", "csv"), ("ERB/a.erb", "script")], "document_id string, file_type string")
    assert {r.namespace for r in S.namespaces(listing, ["ITEM"]).collect()} == {"ITEM", "TAG"}


def test_dictionary_terms_become_tokens(spark):
    df = spark.createDataFrame([("火の薬草と薬 __PH0__", ["%薬%"]), (None, None)], "t string, p array<string>")
    apply = H.dictionary([("薬", "약"), ("薬草", "약초"), ("", "x"), ("と", "와")])
    got = [r.x for r in df.select(apply("t", "p").alias("x")).collect()]
    assert got[0].text == "火の__PH1____PH2____PH3__ __PH0__" and got[0].placeholders == ["%薬%", "약초", "와", "약"] and got[1].text is None
