"""Queries of the script sources and particle functions over generated scripts, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import particles as P
from quillspark.plans.frames import table
from quillspark.plans.generated import WORDS, chosen, chosen_sql, filled, filled_sql, places_sql, scripts
from quillspark.plans.queries import query
from quillspark.sources import script, segments, symbols

SCRIPT = [
    "@関数@n(引数, ARG:1)",
    '#DIMS CONST 表@n = "@w", "赤@n"',
    "PRINTL @wを%NAME:1%が飲む。",
    "PRINTFORML @w %NAME:1% 水@n",
    "PRINTFORM \\@ A == 1 ? 左の@w # 右の@w \\@ です",
    'X = "@w%A%列" + GETCONFIG("@w")',
    'IF NAME == "@w"',
    "名前 = @w",
    ';注釈 "@w"',
    "PRINTDATAL",
    "DATA @w一行",
    'DATAFORM "引用@w"',
    "ENDDATA",
    "HTML_PRINT <b>太字</b>の@w",
    'CALL キャラ検索("@w")',
    "SELECTCASE 表@n:0",
    'CASE "@w"',
    "ENDSELECT",
    'PRINTL "@w@n"',
    "PRINTL 画像/@w.png",
    "PRINTL 12345",
    ';!;PRINTL 特別な@w',
]


def _kind(kind: str, namespace: str = "CAST(NULL AS VARCHAR)") -> dict[str, str]:
    return {"text": "@value", "segment_type": f"'{kind}'", "namespace": namespace}


SEGMENTS = places_sql(SCRIPT, "p_partkey", "part", [
    (1, '#DIMS CONST 表@n = "', "@w", _kind("dims-lookup-key", "'DIMS:表' || CAST(p_partkey AS VARCHAR)")),
    (1, '#DIMS CONST 表@n = "@w", "', "赤@n", _kind("dims-lookup-key", "'DIMS:表' || CAST(p_partkey AS VARCHAR)")),
    (2, "PRINTL ", "@wを%NAME:1%が飲む。", _kind("print-tail")),
    (3, "PRINTFORML ", "@w", _kind("print-tail-fragment")),
    (3, "PRINTFORML @w %NAME:1% ", "水@n", _kind("print-tail-fragment")),
    (4, "PRINTFORM \\@ A == 1 ? ", "左の@w", _kind("inline-conditional-left")),
    (4, "PRINTFORM \\@ A == 1 ? 左の@w # ", "右の@w", _kind("inline-conditional-right")),
    (4, "PRINTFORM \\@ A == 1 ? 左の@w # 右の@w \\@ ", "です", _kind("print-tail")),
    (5, 'X = "', "@w", _kind("quoted-string-fragment")),
    (5, 'X = "@w%A%', "列", _kind("quoted-string-fragment")),
    (7, "名前 = ", "@w", _kind("assignment-value")),
    (10, "DATA ", "@w一行", _kind("print-tail")),
    (11, 'DATAFORM "', "引用@w", _kind("data-dataform")),
    (13, "HTML_PRINT <b>", "太字", _kind("html-print")),
    (13, "HTML_PRINT <b>太字</b>", "の@w", _kind("html-print")),
    (14, 'CALL キャラ検索("', "@w", _kind("character-search-name")),
    (18, 'PRINTL "', "@w@n", _kind("quoted-string")),
    (21, ";!;PRINTL ", "特別な@w", _kind("print-tail")),
])


@query(SEGMENTS)
def script_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = script.logical_lines(scripts(table(spark, sf_dir, "part"), "p_partkey", SCRIPT))
    return segments.segments(lines, symbols.lookup_arrays(lines))


MIXED = [
    'CALL 登録(A, @"夜に%NAME:1%と@wで会った", "日記@n")',
    'X = EXISTS(@"_{GETS("倉庫", 番号, "名前")}_")',
    "PRINTFORML 　体力：{A}円　　@w：{B}分",
    'PRINTFORM \\@ A > 0 ?[1]%名前(A) + "所有@n",24,LEFT% # 未@w  \\@',
    "PRINTFORMW %NAME:1%の",
    "X = 計算(処理(A)) + @w",
    "PRINTFORML [2] - 一覧(@w別)",
    "PRINT <@w>",
    'CALL F(G(H(I(J("深い@n")))))',
    'Y = GETCONFIG(F(G(H("無"))))',
    "#DIMS 名@n =",
    '  "一つ, 目@n",',
    ';注 "無"',
    '  "@w"',
]


@query(places_sql(MIXED, "p_partkey", "part", [
    (0, 'CALL 登録(A, @"', "夜に%NAME:1%と@wで会った", _kind("raw-string")),
    (0, 'CALL 登録(A, @"夜に%NAME:1%と@wで会った", "', "日記@n", _kind("quoted-string")),
    (2, "PRINTFORML 　", "体力：{A}円", _kind("print-tail")),
    (2, "PRINTFORML 　体力：{A}円　　", "@w：{B}分", _kind("print-tail")),
    (3, 'PRINTFORM \\@ A > 0 ?[1]%名前(A) + "', "所有@n", _kind("inline-conditional-left-fragment")),
    (3, 'PRINTFORM \\@ A > 0 ?[1]%名前(A) + "所有@n",24,LEFT% # ', "未@w", _kind("inline-conditional-right")),
    (4, "PRINTFORMW ", "%NAME:1%の", _kind("print-tail-fragment")),
    (5, "X = 計算(処理(A)) + ", "@w", _kind("assignment-fragment")),
    (6, "PRINTFORML ", "[2] - 一覧(@w別)", _kind("print-tail")),
    (7, "PRINT <", "@w", _kind("print-tail-fragment")),
    (8, 'CALL F(G(H(I(J("', "深い@n", _kind("quoted-string")),
    (11, '  "', "一つ, 目@n", _kind("directive-string")),
    (13, '  "', "@w", _kind("directive-string")),
]))
def mixed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings with script inside, strings shown in percent expressions, layout, terms, deep calls, lists over lines."""
    return segments.segments(script.logical_lines(scripts(table(spark, sf_dir, "part"), "p_partkey", MIXED)))


SYMBOLS = [
    "@関数@n(引数, ARG:1)",
    'LOCALS = "@w"',
    'ARGS = A ? "甲" # "乙@n"',
    'NAME_X = "@w" + "型"',
    "X = CFLAG:素質@n + TALENT:LOCALS + ABL:ARG:知識",
    "Y = BASE:ARGS + BASE:UNSET + EXP:12",
    'GETNUM(ITEM, "@w")',
    "変数@n = 引数 + 1",
    "PRINTFORML これは%処理@n(引数)%と{変数@n}です",
    "CALL 呼出@n",
    "#DIM 配列@n, 10",
    ";IF 注釈",
    'PRINTL "変数@n"',
    "TRYCALLFORM 試行@n",
]


def _reference(namespace: str, kind: str, key: str, variable: str, candidates: str, resolution: str) -> dict[str, str]:
    return {"namespace": f"'{namespace}'", "kind": f"'{kind}'", "key": key, "variable": variable, "candidates": candidates, "resolution": f"'{resolution}'"}


_NONE, _W, _N = "CAST(NULL AS VARCHAR)", filled_sql("@w", "p_partkey"), filled_sql("乙@n", "p_partkey")
_ONE = "array_to_string([@value], '|')"
REFERENCES = places_sql(SYMBOLS, "p_partkey", "part", [
    (4, "X = CFLAG:", "素質@n", _reference("CFLAG", "direct", "@value", _NONE, "@value", "direct")),
    (4, "X = CFLAG:素質@n + TALENT:", "LOCALS", _reference("TALENT", "indirect", _NONE, "@value", _W, "resolved")),
    (4, "X = CFLAG:素質@n + TALENT:LOCALS + ABL:ARG:", "知識", _reference("ABL", "direct", "@value", _NONE, "@value", "direct")),
    (5, "Y = BASE:", "ARGS", _reference("BASE", "indirect", _NONE, "@value", f"array_to_string(list_sort(['甲', {_N}]), '|')", "ambiguous")),
    (5, "Y = BASE:ARGS + BASE:", "UNSET", _reference("BASE", "indirect", _NONE, "@value", "''", "unresolved")),
    (6, 'GETNUM(ITEM, "', "@w", _reference("ITEM", "direct", "@value", _NONE, "@value", "direct")),
])


@query(REFERENCES)
def symbol_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = script.logical_lines(scripts(table(spark, sf_dir, "part"), "p_partkey", SYMBOLS))
    return symbols.references(lines).withColumn("candidates", F.array_join("candidates", "|"))


@query(f"""SELECT CAST(p_partkey AS VARCHAR) AS document_id, v.variable, v.keys FROM part, (VALUES ('locals', 0), ('args', 1), ('name_x', 2)) t(variable, k),
  LATERAL (SELECT t.variable, CASE t.k WHEN 0 THEN {_W} WHEN 1 THEN array_to_string(list_sort(['甲', {_N}]), '|') ELSE {_W} || '型' END AS keys) v""")
def variable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = script.logical_lines(scripts(table(spark, sf_dir, "part"), "p_partkey", SYMBOLS))
    return symbols.variable_values(lines).withColumn("keys", F.array_join("keys", "|"))


def _identifier(kind: str, role: str) -> dict[str, str]:
    return {"kind": f"'{kind}'", "role": f"'{role}'", "name": "@value"}


IDENTIFIERS = places_sql(SYMBOLS, "p_partkey", "part", [
    (0, "@", "関数@n", _identifier("function", "definition")),
    (0, "@関数@n(", "引数", _identifier("variable", "argument")),
    (7, "", "変数@n", _identifier("variable", "assignment")),
    (7, "変数@n = ", "引数", _identifier("variable", "reference")),
    (8, "PRINTFORML これは%", "処理@n", _identifier("function", "call")),
    (8, "PRINTFORML これは%処理@n(", "引数", _identifier("variable", "reference")),
    (8, "PRINTFORML これは%処理@n(引数)%と{", "変数@n", _identifier("variable", "reference")),
    (9, "CALL ", "呼出@n", _identifier("function", "call")),
    (10, "#DIM ", "配列@n", _identifier("variable", "declaration")),
    (13, "TRYCALLFORM ", "試行@n", _identifier("function", "call")),
])


@query(IDENTIFIERS)
def script_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.identifiers(script.logical_lines(scripts(table(spark, sf_dir, "part"), "p_partkey", SYMBOLS)))


@query(f"""SELECT DISTINCT upper(name) AS name FROM (SELECT {filled_sql("関数@n", "p_partkey")} AS name FROM part UNION ALL SELECT {filled_sql("処理@n", "p_partkey")} FROM part UNION ALL SELECT 'GETNUM')""")
def code_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script.functions(script.logical_lines(scripts(table(spark, sf_dir, "part"), "p_partkey", SYMBOLS)))


REGISTRY = [
    "@検索@n(要素, 名前)",
    '#DIMS 表@n = "甲/@w/3"',
    "X = FINDELEMENT(表@n, 名前)",
    "@外側@n(名称)",
    "CALL 中継@n",
    "X = 検索@n(1, 名称)",
    'SPLIT_STRING(表@n:0, "/", 部分)',
    "Y = GETNUM(ITEM, 部分:1) + TOINT(部分:2)",
]


@query("""SELECT upper('表' || CAST(p_partkey AS VARCHAR)) AS name, '/' AS delimiter, f AS field, CASE WHEN f = 1 THEN 'ITEM' END AS namespace FROM part, (VALUES (1), (2)) t(f)""")
def split_lookup_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.split_lookups(script.logical_lines(scripts(table(spark, sf_dir, "part"), "p_partkey", REGISTRY)))


@query("""SELECT f || CAST(p_partkey AS VARCHAR) AS "function", a AS argument, 'DIMS:表' || CAST(p_partkey AS VARCHAR) AS namespace FROM part, (VALUES ('検索', 1), ('外側', 0)) t(f, a)""")
def lookup_key_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.key_arguments(script.logical_lines(scripts(table(spark, sf_dir, "part"), "p_partkey", REGISTRY)))


ASKING = ["%CALLNAME:@n%은/는 왔다", "%조사처리(NAME:@n,\"이\")% 왔다", "%플레이어는(@n)% 왔다", "%타겟은()% 왔다", "%MASTER이% 왔다", "%ARG겠% 왔다", "그냥 @n", "%조사만선택( ~ ,\"을/를\")%%조수를%"]
ASKED = {
    0: [("", "%CALLNAME:@n%은/는", '%조사처리(CALLNAME:@n,"는")%', "postfix", "function")],
    1: [("", '%조사처리(NAME:@n,"이")%', '%조사처리(NAME:@n,"이")%', "function", "function")],
    2: [("", "%플레이어는(@n)%", '%조사처리(NAME:MASTER,"는")%', "legacy", "function")],
    3: [("", "%타겟은()%", "%타겟는%", "legacy", "macro")],
    4: [("", "%MASTER이%", "%플레이어가%", "macro", "macro")],
    5: [("", "%ARG겠%", '%조사처리(CALLNAME:ARG,"겠")%', "macro", "function")],
    7: [("", '%조사만선택( ~ ,"을/를")%', '%조사만처리(~,"을")%', "function", "function"), ('%조사만선택( ~ ,"을/를")%', "%조수를%", "%조수를%", "macro", "macro")],
}
_N = "p_partkey"
OCCURRENCES = " UNION ALL ".join(
    f"SELECT {_N}, CAST(length({filled_sql(b, _N)}) AS INTEGER) AS start, CAST(length({filled_sql(v, _N)}) AS INTEGER) AS length, {filled_sql(v, _N)} AS value, {filled_sql(r, _N)} AS replacement, '{k}' AS kind, '{o}' AS output FROM part WHERE {_N} % {len(ASKING)} = {i}"
    for i, rows in ASKED.items()
    for b, v, r, k, o in rows
)


@query(OCCURRENCES)
def particle_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "part").select("p_partkey", chosen(ASKING, F.col("p_partkey")).alias("text"))
    return texts.select("p_partkey", F.explode(P.occurrences(F.col("text"))).alias("x")).select("p_partkey", "x.*")


@query(f"""WITH o AS ({OCCURRENCES}) SELECT p.p_partkey, count(o.kind) AS patterns, count(*) FILTER (o.kind IN ('postfix', 'legacy') OR o.value <> o.replacement) AS convertible, count(*) FILTER (output = 'function') AS functions, count(*) FILTER (output = 'macro') AS macros,
  count(*) FILTER (kind = 'legacy') AS legacy, count(*) FILTER (output = 'macro') > 0 AS needs_header,
  CASE (CASE WHEN count(*) FILTER (output = 'function') > 0 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (output = 'macro') > 0 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (kind = 'legacy') > 0 THEN 1 ELSE 0 END) WHEN 0 THEN 'none' WHEN 1 THEN CASE WHEN count(*) FILTER (output = 'macro') > 0 THEN 'macro' WHEN count(*) FILTER (output = 'function') > 0 THEN 'function' ELSE 'legacy' END ELSE 'mixed' END AS syntax
  FROM part p LEFT JOIN o USING (p_partkey) GROUP BY 1""")
def particle_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "part").select("p_partkey", chosen(ASKING, F.col("p_partkey")).alias("text"))
    out = texts.select("p_partkey", P.summary(P.occurrences(F.col("text"))).alias("x")).select("p_partkey", "x.*")
    return out.select("p_partkey", *(F.col(c).cast("long").alias(c) for c in ("patterns", "convertible", "functions", "macros", "legacy")), "needs_header", "syntax")


LITERAL = ["학교을 @n", "나무은 있다", "길으로 가다", "사람와 @n", "<학교을>학교을", "사과이다.", "책(을)를 @n", "%NAME:1%은/는 3으로", "물이/가, 산는"]
PUT_RIGHT = ["학교를 @n", "나무는 있다", "길로 가다", "사람과 @n", "<학교을>학교을", "사과다.", "책을 @n", '%조사처리(NAME:1,"는")% 3으로', "물이, 산는"]


@query(f"SELECT p_partkey, {chosen_sql(PUT_RIGHT, 'p_partkey')} AS text FROM part")
def rewritten_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "part").select("p_partkey", chosen(LITERAL, F.col("p_partkey")).alias("text"))
    return P.rewritten(texts, "text")


LEADING = [("학교", "은 @n"), ("나무", " 을 보다"), ("%NAME:@n%", "이/가, 왔다"), ("길 ", "으로"), ("@w", "는"), ("학교", "의 @n"), ("학교", "말")]
LED = ["는 @n", " 를 보다", '%조사만처리(NAME:@n,"이")%, 왔다', "로", "는", "의 @n", "말"]


@query(f"SELECT p_partkey, {chosen_sql(LED, 'p_partkey')} AS text FROM part")
def leading_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    texts = table(spark, sf_dir, "part").select(n, chosen([a for a, _ in LEADING], n).alias("a"), chosen([b for _, b in LEADING], n).alias("b"))
    return texts.select("p_partkey", P.leading_particle(F.col("a"), F.col("b")).alias("text"))


@query(f"""SELECT p_partkey, {filled_sql("X = ITEM:새@w + ITEM:빈 + CFLAG:MASTER:새@w", "p_partkey")} AS text, p_partkey % 3 = 0 AS lookup FROM part""")
def inline_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References renamed inside texts, and whether a place is the key argument of a lookup."""
    n = F.col("p_partkey")
    renames = F.create_map(*(F.lit(x) for w in WORDS for space in ("ITEM", "CFLAG") for x in (f"{space}:{w}", f"새{w}")))
    text = filled("X = ITEM:@w + ITEM:빈 + CFLAG:MASTER:@w", n)
    place = F.concat(F.when(n % 3 == 0, "GETNUM(ITEM, ").when(n % 3 == 1, "GETNUM(ITEM,\n").otherwise("GETNUM(ITEM "), F.lit('"x'))
    return table(spark, sf_dir, "part").select(n, symbols.rewritten_references(text, renames).alias("text"), symbols.in_string_lookup(place, F.length(place)).alias("lookup"))




LOOKUPS = [
    "@検索@n(要素, 名前)",
    '#DIMS 表@n = "甲", "@w"',
    "X = FINDELEMENT(表@n, 名前)",
    'IF 表@n:0 == "@w" || A == "他"',
    "SELECTCASE 表@n:ARG",
    'CASE "甲", "@w"',
    "ENDSELECT",
    "SELECTCASE ITEMNAME:ARG",
    'CASE "@w"',
    "ENDSELECT",
    'CALL F(FINDELEMENT(表@n, "乙"))',
    'Y = 検索@n(1, "丙@n")',
    'Z = GET("ITEM", "@w", "12")',
]


def _key(namespace: str) -> dict[str, str]:
    return {"namespace": namespace, "key": "@value"}


_DIMS = "'DIMS:表' || CAST(p_partkey AS VARCHAR)"


@query(places_sql(LOOKUPS, "p_partkey", "part", [
    (3, 'IF 表@n:0 == "', "@w", _key(_DIMS)),
    (5, 'CASE "', "甲", _key(_DIMS)),
    (5, 'CASE "甲", "', "@w", _key(_DIMS)),
    (8, 'CASE "', "@w", _key("'ITEM'")),
    (10, 'CALL F(FINDELEMENT(表@n, "', "乙", _key(_DIMS)),
    (11, 'Y = 検索@n(1, "', "丙@n", _key(_DIMS)),
    (12, 'Z = GET("ITEM", "', "@w", _key("'ITEM'")),
]))
def lookup_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings that name keys by where they stand: compared, labels, searched for, key arguments."""
    return symbols.lookup_references(script.logical_lines(scripts(table(spark, sf_dir, "part"), "p_partkey", LOOKUPS)))
