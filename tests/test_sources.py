"""Sources, text functions and the streaming sink on literal fixtures."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import intervals as I
from quillspark.operators import lexicon as L
from quillspark.sources import project as P
from quillspark.streaming.progress import VersionedTable, hit_counts


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def test_project_tree(spark, tmp_path):
    base = tmp_path / "game"
    for name, data in {
        "CSV/Item.csv": "0,薬草\r\n;note\r\n1,\"a,\"\"b\"\"\"\r\n".encode("cp932"),
        "ERB/Main.ERB": "PRINTDATA\nDATAFORM 今日は\n".encode("euc_jp"),
        "ERB/Bom.erb": b"\xef\xbb\xbfPRINTL x\n",
        "ERB/Wide.erh": b"\xff\xfe" + "#DIM A\r\n".encode("utf-16-le"),
        "other/No.erb": b"x",
        "ERB/readme.txt": b"x",
    }.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(data)
    docs = {r.document_id: r for r in P.documents(P.files(spark, str(base))).collect()}
    assert sorted(docs) == ["CSV/Item.csv", "ERB/Bom.erb", "ERB/Main.ERB", "ERB/Wide.erh"]
    assert docs["CSV/Item.csv"].encoding == "cp932" and docs["CSV/Item.csv"].newline == "\r\n" and "薬草" in docs["CSV/Item.csv"].text
    assert docs["ERB/Main.ERB"].encoding == "euc_jp" and docs["ERB/Main.ERB"].warnings == ["PRINTDATA without ENDDATA"]
    assert docs["ERB/Bom.erb"].text == "PRINTL x\n" and docs["ERB/Wide.erh"].encoding == "utf-16-le"
    back = P.documents(P.files(spark, str(base))).select("document_id", P.encoded("text", "encoding").alias("b")).collect()
    assert all(bytes(r.b) == (base / r.document_id).read_bytes() for r in back)


def test_csv_fields_and_rebuild(spark):
    lines = ['a, "b,""c""" ,d', "x,", "", ' 1\t,"open', '"q"']
    values = column(spark, lines, P.csv_fields)
    assert [[f.value for f in x] for x in values] == [["a", 'b,"c"', "d"], ["x", ""], [""], ["1", '"open'], ["q"]]
    assert [f.raw_start for f in values[0]] == [0, 2, 14] and values[0][1].leading == " " and values[0][1].trailing == " "
    assert all(line == ",".join(f.raw for f in x) for line, x in zip(lines, values, strict=True))
    made = column(spark, lines[:2], lambda t: P.rebuilt(P.csv_fields(t), F.create_map(F.lit(1), F.lit('n,"1"'))))
    assert made == ['a, "n,""1""" ,d', 'x,"n,""1"""']


def test_csv_kind(spark):
    rows = [("CSV/VariableSize.csv", ["A", "1"]), ("CSV/Chara01.csv", ["x"]), ("CSV/a.csv", ["番号", "1"]), ("CSV/b.csv", ["3", "x"]), ("CSV/c.csv", ["k", "v"]), ("CSV/d.csv", ["k", "v", "w"])]
    df = spark.createDataFrame(rows, "d string, f array<string>")
    assert [r.k for r in df.select(P.csv_kind(F.col("d"), F.col("f")).alias("k")).collect()] == ["Generic", "CharacterSheet", "CharacterSheet", "IdFirst", "KeyValue", "Generic"]


def test_exchange_round_trip(spark):
    rows = spark.createDataFrame([("a:1", "x\ny", "z"), ("b:2", "q", "")], "id string, original string, translation string")
    text = "\n".join(r.value for r in P.write_exchange(rows).collect()) + "\n"
    assert sorted(map(tuple, P.read_exchange(spark.createDataFrame([(text,)], "text string")).collect())) == [("a:1", "x\ny", "z"), ("b:2", "q", "")]


def test_zip_entries(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ("ERB/a.erb", "../up", "/abs", "erb/A.ERB"):
            z.writestr(name, "x")
    got = P.zip_entries(spark.createDataFrame([("p", bytearray(data.getvalue()))], "path string, content binary")).collect()
    assert {r.name: r.problem for r in got} == {"ERB/a.erb": None, "../up": "unsafe", "/abs": "unsafe", "erb/A.ERB": "duplicate"}


def test_language_and_key_functions(spark):
    texts = ["今日は", "안녕 hello", "hello", "%NAME%", "12/3%", "", None, "abc_1", "火／水", "ー"]
    assert column(spark, texts, lambda t: T.is_likely_language(t, "ja")) == [True, False, False, False, False, False, False, False, True, True]
    assert column(spark, texts, lambda t: T.is_entirely_language(t, "en")) == [False, False, True, False, False, False, False, True, False, False]
    assert column(spark, texts[:6], lambda t: T.contains_language(t, "ko")) == [False, True, False, False, False, False]
    assert column(spark, texts[:6], T.looks_like_code_only) == [False, False, False, True, True, True]
    assert column(spark, texts[:6], T.is_numeric_like) == [False, False, False, False, True, False]
    assert column(spark, ["abc_1", "火／水", "今日", "a b"], T.looks_like_lookup_key) == [True, True, False, False]
    assert column(spark, ["😀a"], T.utf16_length) == [3]


def test_particles_and_reviews(spark):
    assert column(spark, ["책", "나무", "길", "3", "7", "x"], lambda t: T.particle(t, "은", "는")) == ["은", "는", "은", "은", "은", "는"]
    assert column(spark, ["책", "나무", "길"], lambda t: T.particle(t, "으로", "로", True)) == ["으로", "로", "로"]
    df = spark.createDataFrame([("ab", "a/b"), ("ab", "a(bc)"), ("あい", "abc"), ("abcd", "ab"), ("あい", "가나")], "o string, t string")
    assert [r.x for r in df.select(T.review_reason(F.col("o"), F.col("t")).alias("x")).collect()] == ["alternatives", "parentheses", "ascii_word", "length", None]
    assert column(spark, ["a, b", "  "], lambda t: T.csv_text(t, F.lit(False))) == ["a、b", "  "]
    assert column(spark, ["x\r\n\n y \rz"], T.preview) == ["x ↵ y ↵ z"]
    assert column(spark, ["api_key=abc ok"], T.masked_secrets) == ["api_key=*** ok"]


def test_edits_and_terms(spark):
    df = spark.createDataFrame([("hello world", [(0, 5, "bye"), (6, 5, "moon")]), ("x", [])], "t string, e array<struct<start:int,length:int,value:string>>")
    assert [r.x for r in df.select(I.apply_edits(F.col("t"), F.col("e")).alias("x")).collect()] == ["bye moon", "x"]
    terms = spark.createDataFrame([("薬草",), ("草",)], "term string")
    got = L.contained_terms(spark.createDataFrame([(1, "薬草と草")], "k int, t string"), "k", "t", terms, "term", 4).collect()
    assert sorted((r.term, r.start) for r in got) == [("草", 1), ("草", 3), ("薬草", 0)]


def test_versioned_upserts_by_stream(spark, tmp_path):
    out = VersionedTable(spark, str(tmp_path / "progress"))
    out.write(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, seq int, t string"))
    spark.createDataFrame([("a", 2, "z"), ("c", 1, "w"), ("b", 0, "old")], "id string, seq int, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, seq int, t string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        out.follow(stream, ["id"], "seq", str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(map(tuple, out.read().collect())) == [("a", 2, "z"), ("b", 1, "y"), ("c", 1, "w")]
    out.delete(spark.createDataFrame([("a",)], "id string"))
    assert out.read().count() == 2
    log = spark.createDataFrame([("k", "v1", 1), ("k", "v2", 2)], "k string, v string, n int")
    assert [tuple(r) for r in hit_counts(log, "k", "v", "n").collect()] == [("k", "v2", 2)]
