"""Queries of the scalar functions: texts made from the rows of ``part`` by templates, and what each must become."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import placeholders, reading, responses, rules
from quillspark.functions import text as T
from quillspark.plans.frames import table
from quillspark.plans.generated import chosen, filled_sql
from quillspark.plans.queries import query
from quillspark.sources import syntax

N = "p_partkey"


def cases(name: str, doc: str, rows: list[tuple[str | None, ...]], value: Callable[..., Column]) -> None:
    """Registers a query: row k of the table takes case k modulo the number of cases; the last of a case is expected."""
    when = " ".join(f"WHEN {k} THEN {'NULL' if r[-1] is None else filled_sql(r[-1], N)}" for k, r in enumerate(rows))
    inputs = [[r[i] for r in rows] for i in range(len(rows[0]) - 1)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = table(spark, sf_dir, "part").select(N, *(chosen(x, F.col(N)).alias(f"x{i}") for i, x in enumerate(inputs)))
        for i in range(len(inputs)):
            texts = texts.withColumn(f"x{i}", F.nullif(F.col(f"x{i}"), F.lit("NULL")))
        return texts.select(N, value(*(F.col(f"x{i}") for i in range(len(inputs)))).cast("string").alias("value"))

    run.__name__, run.__doc__ = name, doc
    query(f"SELECT {N}, CASE {N} % {len(rows)} {when} END AS value FROM part")(run)


def yes(*texts: str) -> list[tuple[str, str]]:
    return [(t, "true") for t in texts]


def no(*texts: str) -> list[tuple[str, str]]:
    return [(t, "false") for t in texts]


cases("translatable_texts", "Kana, Han or full-width forms.", yes("@w", "カナ@n", "ＡＢＣ", "a々@w") + no("abc @n", "", "   ", "한국어"), T.contains_translatable)
cases("code_only_texts", "Nothing but markup, digits, marks.", yes("%NAME:@n% {A}", "12 + 3", "<b></b>", "……") + no("@w", "a %B%", "한"), T.looks_like_code_only)
cases("symbol_expressions", "References, names and operators only.", yes("CFLAG:ARG:@w + TALENT:1", "abl:@w == 3", "FLAG:{A}") + no("@w", "A + B", "CFLAG:@w を", ""), syntax.looks_like_symbol_expression)
cases("numeric_texts", "Numbers, ratios, switches.", yes("@n", "-12.5", "0xFF", "1/2/3", "50%", "50％", "TRUE", " OFF ") + no("1a", "", "@w", "1.", "true"), T.is_numeric_like)
cases("resource_paths", "File names of known kinds.", yes("img/@n.png", 'a\\b.OGG', '@"x/@w.txt"', "%A%.csv") + no("a b.png", "a/b/c", "x.exe", ".", "@w"), rules.looks_like_resource_path)
cases("likely_japanese", "More kana and Han than Hangul.", yes("@wです", "漢a", "カ 한", "%한글%@w") + no("한글", "abc", "123", "", "@w 한글한글"), lambda t: T.is_likely_language(t, "ja"))
cases("likely_korean", "At least as much Hangul as Japanese.", yes("한글", "한@n", "가나 カ", "한 abc abc") + no("@w", "", "abc"), lambda t: T.is_likely_language(t, "ko"))
cases("likely_english", "At least as many Latin letters as others.", yes("abc", "ab @n 한", "a カ") + no("@w", "한글 a", ""), lambda t: T.is_likely_language(t, "en"))
cases("entirely_korean", "Hangul only, marks and digits aside.", yes("한글!", "한 글 @n", "<b>한글</b>") + no("한a", "@w", "", "12"), lambda t: T.is_entirely_language(t, "ko"))
cases("containing_japanese", "Some kana or Han outside markup.", yes("a@w", "ab ひ") + no("%@w%", "한", "ーー", ""), lambda t: T.contains_language(t, "ja"))
cases("without_placeholders", "Markup taken out.", [("a%B:@n%c", "ac"), ("{x}y<z>", "y"), ("%a", "%a"), ("@w", "@w")], T.strip_placeholders)
cases("final_consonants", "The number of the last syllable's final consonant.", [("가", "0"), ("강", "21"), ("길", "8"), ("책@n2", "0"), ("3", "1"), ("7", "8"), ("abc", None)], T.coda)
cases("particle_forms", "Topic and direction particles.", [("나무", "는로"), ("책", "은으로"), ("길", "은로"), ("@n2", "는로"), ("", "는로")], lambda t: F.concat(T.particle(t, "은", "는"), T.particle(t, "으로", "로", rieul_as_none=True)))
cases("previews", "One line of a text.", [("a\n b \r\n\n@w", "a ↵ b ↵ @w"), ("@n", "@n"), ("\n\n", ""), (" x ", "x")], T.preview)
cases("katakana_readings", "Katakana in Hangul.", [("アリス", "아리스"), ("キャット", "캬토"), ("パン", "판"), ("ッン", "ㄴ"), ("コーヒー", "코히"), ("ジャン／ルー", "잔／루"), ("ロック・@w", None), ("ひら", None), ("ンン", "ㄴㄴ"), ("ァ", None), ("ベッド", "베또")], reading.katakana_reading)
cases("initial_sounds", "Syllables as they are spoken first in a word.", [("라", "나"), ("려", "여"), ("녀", "여"), ("나", "나"), ("가", "가"), ("x", "x")], reading.initial_sound)
cases("term_base_forms", "Strings of a run, and what they may be forms of.", [("見た", "た|見|見た"), ("食べない", "|".join(sorted({"食", "べ", "な", "い", "食べ", "べな", "ない", "食べな", "べない", "食べない", "食べる", "べる"}))), ("ab 水@n", "水"), ("abc", "")], lambda t: F.array_join(rules.term_candidates(t, 1, 4), "|"))
cases("masked_secrets", "Secrets in log lines.", [("api_key=abc@n x", "api_key=*** x"), ("Password: p", "Password: ***"), ("TOKEN = t, y", "TOKEN = *** y"), ("@w", "@w")], T.masked_secrets)
cases("csv_texts", "Texts of CSV fields.", [("a, b", "NULL", "a、b"), ("「 @w 」 x", "NULL", "「@w」x"), ("a, b c", "keep", "a、b c"), ("　", "NULL", "　"), ("a　b\t@n", "NULL", "ab@n")], lambda t, k: T.csv_text(t, k.isNotNull()))
cases("identifier_texts", "Identifiers without blanks.", [(" a b　@w ", "ab@w"), ("  ", ""), ("x 、 y", "x、y"), ("@n", "@n")], rules.identifier_text)
cases("identifier_failures", "What makes an identifier invalid.", [("@w", None), (" ", "blank"), ("a:b", "invalid_character"), ("a、b", "invalid_character"), ("이름@n", None), ("a#", "invalid_character")], rules.identifier_failure)
cases("hard_failures", "Translations that fail.", [("", "@w", "blank"), ("@w", "@w", "source_language"), ("번역 @n", "@w", None), ("번역 CFLAG:@w", "@w", None), ("번역 @w", "x", "source_language"), ("ABC", "ABC", None)], lambda a, b: rules.hard_failure(a, b, "ja", "ko"))
cases("review_reasons", "Why a translation is for review.", [("@w", "가/나", "alternatives"), ("a/b", "가/나", None), ("@w", "가(설명)", "parentheses"), ("@w", "가 hello", "ascii_word"), ("@w", "가", "length"), ("@w", "가나다라", "length"), ("@w", "가나", None), ("@w", "", None)], T.review_reason)
cases("resolved_states", "The state of a translation.", [("", "@w", "FAILED:blank"), ("가나", "@w", "DONE"), ("가 나 다", "@w", "NEEDS_REVIEW:length"), ("@w", "@w", "FAILED:source_language")], lambda a, b: F.concat_ws(":", rules.resolved(a, b, "ja", "ko")["status"], rules.resolved(a, b, "ja", "ko")["reason"]))
cases("language_actions", "Items excluded, restored or reused by language.", [("한글", "PENDING", "reuse"), ("abc", "PENDING", "exclude"), ("@w", "PENDING", None), ("abc", "DONE", None), ("@w", "AUTO_EXCLUDED", "restore"), ("abc", "AUTO_EXCLUDED", "exclude")], lambda t, s: rules.language_filter(t, F.lit(""), s, "ja", "ko"))
cases("provider_errors", "Labels of errors.", [("timeout", "NULL", "timeout"), ("http", "50@n", "HTTP 50@n"), ("http", "NULL", "HTTP error"), ("json", "1", "JSON error"), ("other", "NULL", "provider error")], responses.error_label)
cases("argument_separators", "Ideographic commas in calls.", [("F(a、b)、c", "F(a,b)、c"), ("(a、b)", "(a、b)"), ("조사처리(A、\"x、y\")", '조사처리(A,"x、y")'), ("{A、B}、", "{A,B}、"), ("{가、나}", "{가、나}"), ("@w、x", "@w、x")], responses.argument_separators)
cases("rendered_lengths", "Room that a hint takes.", [("ab", "cde", "9"), ("", "", "4"), ("@w", "x", "7")], T.rendered_length)
cases("tag_priorities", "Scores of priority tags.", [("news1,ichi2", "500"), ("nf05", "195"), ("nf300", "1"), ("zz", "100"), ("gai2,spec2", "250"), (" news2 ", "300")], lambda t: rules.tag_priority(F.split(t, ",")))
cases("hint_scores", "Static scores of hints by kind.", [("@w", "bundle", str(6 + 55 + 10 + 2)), ("ab", "plain", "106"), ("abc", "manual", "129"), ("@w", "review", "81")], lambda t, k: rules.hint_score(t, k == "bundle", F.lit(False), F.lit(False), F.lit(False), F.lit(1000), F.lit(False), F.when(k == "manual", "MANUAL").when(k == "review", "NEEDS_REVIEW").otherwise("DONE")))
cases("marked_tokens", "Tokens as markers of two styles.", [("a __PH0__ & __PH1__", 'a <ph idx="0"/> &amp; <ph idx="1"/>#a PHTOKEN0SAFE & PHTOKEN1SAFE'), ("<@w>", "&lt;@w&gt;#<@w>")], lambda t: F.concat_ws("#", responses.marked(t, F.array(F.lit("x"), F.lit("y")), "xml"), responses.marked(t, F.array(F.lit("x"), F.lit("y")), "word")))
cases("unmarked_tokens", "Markers back to tokens.", [('a <ph idx="0"/><ph idx=\'1\'></ph>', "a __PH0____PH1__"), ("@w PHTOKEN1SAFE", "@w __PH1__"), ("PHTOKEN9SAFE", "PHTOKEN9SAFE")], lambda t: responses.unmarked(responses.unmarked(t, F.array(F.lit("x"), F.lit("y")), "xml"), F.array(F.lit("x"), F.lit("y")), "word"))
cases("restored_tokens", "Tokens repaired and restored.", [("a__PH0__b__PH1__", "aXbY"), ("_PH0__ __PH1_", "X Y"), ("_PH7_ @w", "_PH7_ @w"), ("__PH 0_", "X")], lambda t: placeholders.restore(t, F.array(F.lit("X"), F.lit("Y"))))
cases("token_errors", "Whether all tokens are there, in order.", [("__PH0__ @w __PH1__", None), ("__PH0__", "count"), ("__PH1__ __PH0__", "order"), ("__PH0__ __PH0__", "order"), ("@n", "count")], lambda t: placeholders.token_error(t, F.array(F.lit("X"), F.lit("Y"))))
_ANSWER = lambda ids, tokenized: (lambda t: F.array_join(F.transform(responses.finalized(responses.translations(t, F.array(*map(F.lit, ids)), tokenized), F.array(*map(F.lit, ids))), lambda x: F.concat_ws("=", x["id"], x["translated"])), ";"))
cases("json_answers", "Answers in JSON, for two ids; all or nothing.", [
    ('{"translations": [{"id": "a", "translated": "가@n"}, {"id": "b", "translated": "나"}]}', "a=가@n;b=나"),
    ('<think>x</think>```json\n[{"id": "b", "translated": "나"}, {"id": "a", "translated": "번역: 가"}]\n```', "a=가;b=나"),
    ('{"translations": [{"id": "a", "translated": "가"}]}', None), ("no json @n", None),
    ('{"translations": [{"id": "a", "translated": " "}, {"id": "b", "translated": "x"}]}', None),
], _ANSWER(["a", "b"], False))
cases("block_answers", "Answers in blocks, for two ids.", [
    ("|a|\n가@n\n|\n|b|\n나\n다\n|", "a=가@n;b=나\n다"), ("SEGMENT a\n가\nEND SEGMENT\nSEGMENT b\n나\nEND SEGMENT", "a=가;b=나"), ("plain @w", None), ("|a|\n가\n|", None),
], _ANSWER(["a", "b"], True))
cases("single_answers", "Answers for one id need no block.", [("가@n", "a=가@n"), ("Translation: 가", "a=가"), ("|a|\n가\n|", "a=가"), ('{"x": 1}', None), ("", None)], _ANSWER(["a"], True))

PROTECTED = [("a %NAME:@n% b", "a __PH0__ b", "%NAME:@n%"), ("<b>@w</b>", "__PH0__@w__PH1__", "<b>|</b>"), ("\\n{A%B%}", "__PH0__{A__PH1__}", "\\n|%B%"), ("[ 3 ] CFLAG:@w x", "__PH0__ __PH1__ x", "[ 3 ]|CFLAG:@w"), ("&amp;@w", "__PH0__@w", "&amp;"), ("F:(a(b)) @n", "__PH0__ @n", "F:(a(b))"), ("@w", "@w", "")]
_PICK = lambda k: " ".join(f"WHEN {i} THEN {filled_sql(r[k], N)}" for i, r in enumerate(PROTECTED))


@query(f"SELECT {N}, CASE {N} % {len(PROTECTED)} {_PICK(1)} END AS text, CASE {N} % {len(PROTECTED)} {_PICK(2)} END AS placeholders FROM part")
def protected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup as numbered tokens, and what they stand for."""
    texts = table(spark, sf_dir, "part").select(N, chosen([r[0] for r in PROTECTED], F.col(N)).alias("t"))
    return placeholders.protected(texts, "t", "p").select(N, "p.text", F.array_join("p.placeholders", "|").alias("placeholders"))


@query(f"""SELECT {N}, replace(replace({filled_sql("@wと@n __PH0__", N)}, '薬草', '__PH1__'), '水筒', '__PH1__') AS text, CASE {N} % 8 WHEN 0 THEN 'x|약초' WHEN 1 THEN 'x|물통' ELSE 'x' END AS placeholders FROM part""")
def dictionary_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's dictionary put in as tokens, longest source first."""
    texts = table(spark, sf_dir, "part").select(N, chosen(["@wと@n __PH0__"], F.col(N)).alias("t"))
    put = placeholders.dictionary([("水筒", "물통"), ("薬草", "약초"), ("薬", "약"), (" ", "x")])
    out = texts.select(N, F.explode(F.array(put("t", F.array(F.lit("x"))))).alias("p"))
    return out.select(N, "p.text", F.array_join("p.placeholders", "|").alias("placeholders"))


@query(f"""SELECT {N}, CASE {N} % 4 WHEN 0 THEN '노녀' WHEN 1 THEN '여로' WHEN 2 THEN '노／여' END AS reading FROM part WHERE {N} % 4 < 3""")
def name_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Han names read by a table of readings, with the initial-sound rule in each part."""
    names = table(spark, sf_dir, "part").select(N, F.element_at(F.array(*map(F.lit, ["露女", "女露", "露／女", "露x"])), (F.col(N) % 4 + 1).cast("int")).alias("name"))
    table_ = spark.createDataFrame([("露", "로"), ("女", "녀")], "kanji string, reading string")
    return reading.han_readings(names, N, F.col("name"), table_)
