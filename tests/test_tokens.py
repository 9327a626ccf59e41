"""Tokens of script lines: any depth, exact places, strings with script inside; and what segments and symbols make of them."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.sources import script, segments, symbols
from quillspark.sources import tokens as K

NAMES = st.sampled_from(["F", "計算", "G_1"])
LEAF = st.sampled_from(["1", "A", '"文"', '"a(b, c"', '@"x%G("y")%z"', "表:0", '""'])


@st.composite
def call(draw, depth=0):
    """(text, calls below and with it as (function, arguments))."""
    name, own, found = draw(NAMES), [], []
    for _ in range(draw(st.integers(1, 3))):
        if depth < 7 and draw(st.booleans()):
            text, below = draw(call(depth + 1))
            found += below
        else:
            text = draw(LEAF)
            found += [("G", ['"y"'])] if "%G" in text else []
        own.append(text)
    text = f"{name}({', '.join(own)})"
    return text, [(name, own), *found]


@settings(max_examples=150, deadline=None)
@given(call())
def test_calls_of_any_depth(made):
    text, expected = made
    line = f"X = {text} + 1"
    got = [(t.name, [a["value"] for a in K.arguments(line, t)]) for t in K.lex(line) if t.kind == "call"]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    for t in K.lex(line):
        assert t.kind != "call" or line[t.start : t.end].startswith(t.name)
        assert all(line[a["start"] : a["start"] + len(a["value"])] == a["value"] for a in K.arguments(line, t))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='F(),"@%{}[] a;', max_size=40))
def test_odd_lines_have_nested_tokens(line):
    own = K.lex(line)
    for k, t in enumerate(own):
        assert -1 <= t.parent < k and 0 <= t.start < t.end <= len(line)
        assert t.parent < 0 or own[t.parent].start <= t.start and t.end <= own[t.parent].end


def lines(spark, text):
    return script.logical_lines(spark.createDataFrame([("d", text), ("none", None), ("empty", "")], "document_id string, text string"))


def test_calls_beyond_three_levels(spark):
    own = lines(spark, 'A(B(C(D(1))), "k")\nX = GETNUM(ITEM, "甲", F((((1)))))\nPRINTL "A(1)"')
    got = symbols.calls(own).collect()
    assert {r.function for r in got} == {*"ABCDF", "GETNUM"}
    assert [[a.value for a in r.arguments] for r in got if r.function == "A"] == [["B(C(D(1)))", '"k"']]
    found = symbols.references(own).where("namespace = 'ITEM'").collect()
    assert [(r.key, r.length) for r in found] == [("甲", 1)]


CASES = {
    "raw strings": ('CALL 登録(A, @"夜に%NAME:1%と会った", "日記")\nX = EXISTS(@"_{GETS("倉庫", 番号, "名前")}_")', {("夜に%NAME:1%と会った", "raw-string"), ("日記", "quoted-string")}),
    "raw markup": ('CALL 登録(A, @"<b c=\'#%カラーパレット("赤")%\'>%NAME:1%の勝ち</b><img src=\'絵\'>", "終")', {("勝ち", "html-markup-fragment"), ("終", "quoted-string")}),
    "layout": ("PRINTFORML 　体力：{A}円　　気力：{B}分\nPRINTFORML 力:LV{A} 技:LV{B}", {("体力：{A}円", "print-tail"), ("気力：{B}分", "print-tail"), ("力:LV{A}", "print-tail"), ("技:LV{B}", "print-tail")}),
    "shown in percent": ('PRINTFORM \\@ A > 0 ?[1]%名前(A) + "所有",24,LEFT% # 未所有  \\@', {("所有", "inline-conditional-left-fragment"), ("未所有", "inline-conditional-right")}),
    "spans": ("PRINTFORMW %NAME:1%の魔法使い\nPRINTFORMW %NAME:1%の\nX = 計算(処理(A)) + 魔力2\nPRINT <露>\nPRINT <br>", {("魔法使い", "print-tail-fragment"), ("%NAME:1%の", "print-tail-fragment"), ("魔力2", "assignment-fragment"), ("露", "print-tail-fragment")}),
    "kept whole": ("PRINTFORML [2] - 一覧(種類別)\nPRINTFORML %NAME:1%は帰った\nDATA 外", {("[2] - 一覧(種類別)", "print-tail"), ("%NAME:1%は帰った", "print-tail")}),
    "terms": ('A = 高校 + "です"\nB = C ? 左 # (右)\nC = 鞄 ; 注\nD = IS(E) && !TALENT:X:監視', {("高校", "assignment-fragment"), ("です", "quoted-string"), ("左", "assignment-fragment"), ("右", "assignment-fragment"), ("鞄", "assignment-value")}),
    "declarations": ('#DIMS CONST 名 =\n  "一つ, 目",\n;注 "無"\n  "二つ"\n#DIM CONST 数 = MAX(\n  VARSIZE("名"),\n  VARSIZE("別")\n)\nX = "次"', {("一つ, 目", "directive-string"), ("二つ", "directive-string"), ("次", "quoted-string")}),
    "compared": ('IF A == "甲" || "乙" != B\nX = GETCONFIG("丙")\nPRINT_IMG "丁"\nLOADTEXT "戊"\nX = "己"', {("己", "quoted-string")}),
    "titles": ("PRINTDATA\nDATAFORM @\"<button title='説明'>開始</button>\"\nDATALIST\nDATA 中\nENDLIST\nENDDATA\nPRINT_TAG = <b title='選択'>可</b>", {("説明", "data-dataform-markup"), ("開始", "data-dataform-markup"), ("中", "print-tail"), ("選択", "html-tail"), ("可", "html-tail")}),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_segments(spark, name):
    text, expected = CASES[name]
    got = segments.segments(lines(spark, text)).collect()
    assert all(text[r.start : r.start + r.length] == r.text and text.count("\n", 0, r.start) >= r.line_number for r in got)
    assert {(r.text, r.segment_type) for r in got} == expected


def test_select_case_stack(spark):
    text = 'ENDSELECT\nENDSELECT\nSELECTCASE A:0\nSELECTCASE B:0\nCASE "b"\nENDSELECT\nCASE "a"\nENDSELECT\nX'
    got = {r.line_number: (r.depth, r.selected) for r in segments.with_state(lines(spark, text)).where("document_id = 'd'").collect()}
    assert [got[k] for k in (0, 3, 4, 6, 8)] == [(0, None), (2, "B"), (2, "B"), (1, "A"), (0, None)]


def test_keys_by_their_place(spark):
    own = lines(spark, 'X = CALC_CHARA_SINGLE_DATA("TALENT", A, "気骨*3, 反抗 ,12")\nX = CALC_CHARA_SINGLE_DATA_RULED("ABL", A, "甲*2|乙")\nX = GET_NONEXISTABLE_EXP_BYNAME("経験")\nX = CALC_CHARA_SINGLE_DATA("無", A, "丙")')
    got = {(r.line_number, r.namespace, r.key) for r in symbols.key_list_references(own).collect()}
    assert got == {(0, "TALENT", "気骨"), (0, "TALENT", "反抗"), (1, "ABL", "甲"), (1, "ABL", "乙"), (2, "EXP", "経験")}
    text = '#DIMS 表 = "赤/1/青", "白/2"\nSPLIT_STRING(表:0, "/", 部)\nX = GETNUM(ITEM, 部:0) + TOINT(部:1)'
    own = lines(spark, text)
    found = symbols.split_key_references(own, symbols.split_lookups(own)).collect()
    assert {(r.namespace, r.key, text[r.start : r.start + r.length]) for r in found} == {("ITEM", "赤", "赤"), ("ITEM", "白", "白")}


def test_literals_of_variables(spark):
    text = 'A = "甲"\nB = C ? "乙" # (D ? "丙" # E)\nF = "丁" + "戊"\nX = TALENT:A + GETNUM(ITEM, 名)\n名 = "己"'
    own = lines(spark, text)
    got = symbols.variable_literals(own).collect()
    assert {(r.variable, r.key, text[r.start : r.start + r.length]) for r in got} == {("a", "甲", "甲"), ("b", "乙", "乙"), ("名", "己", "己")}
    found = {(r.namespace, r.variable, tuple(r.candidates), r.resolution) for r in symbols.references(own).collect()}
    assert found == {("TALENT", "A", ("甲",), "resolved"), ("ITEM", "名", ("己",), "resolved")}


def test_names_of_properties_and_namespaces(spark):
    text = "合計 = 箱.重さ + 重さ\n札:0 = 1\n重さ.値 = 合計"
    got = symbols.identifiers(lines(spark, text)).collect()
    assert {(r.line_number, r.name, r.role) for r in got} == {(0, "合計", "assignment"), (0, "重さ", "reference"), (2, "合計", "reference")}
    assert all(text[r.start : r.start + r.length] == r.name for r in got)
