"""Korean particles: rules by final consonant, patterns that ask for them, and rewriting them in texts.

A particle has a form after a vowel and one after a final consonant; texts name it in any of the accepted ways (either
form, or both with a slash or brackets).  Patterns that ask for a particle are found with their places, and become a call
of a helper function or one of the macros."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import placeholders
from quillspark.functions.places import bound, found, replaced
from quillspark.operators.intervals import non_overlapping

# Key, form after a vowel, form after a consonant, macro suffix, argument of the helper, whether there is a
# macro, and marks (pass: same in all cases; long: short forms in texts are left alone; ro: the vowel form after rieul).
RULES = [
    ("topic", "는", "은", "는", "는", True, ""),
    ("subject", "가", "이", "가", "이", True, ""),
    ("object", "를", "을", "를", "을", True, ""),
    ("comitative", "와", "과", "와", "과", True, ""),
    ("direction", "로", "으로", "로", "으로", True, "ro"),
    ("companion", "랑", "이랑", "랑", "랑", True, ""),
    ("connective", "며", "이며", "며", "며", True, "long"),
    ("conjunctive", "고", "이고", "고", "고", True, "long"),
    ("predicative", "라", "이라", "라", "라", True, "long"),
    ("copula", "다", "이다", "다", "다", True, "long"),
    ("pastCopula", "였", "이었", "였", "였", True, "long"),
    ("endingYeo", "여", "이여", "여", "여", True, "long"),
    ("endingYa", "야", "이야", "야", "야", True, "long"),
    ("orChoice", "나", "이나", "나", "이나", True, "long"),
    ("conditional", "면", "이면", "면", "이면", True, "long"),
    ("future", "겠", "이겠", "겠", "겠", False, "long"),
    ("honorificPast", "셨", "이셨", "셨", "셨", False, "long"),
    ("emphatic", "잖", "이잖", "잖", "잖", False, "long"),
    ("interrogative", "니", "이니", "니", "니", False, "long"),
    ("genitive", "의", "의", "의", "의", True, "pass"),
    ("dative", "에게", "에게", "에게", "에게", True, "pass"),
]
EXTRA_FORMS = {"pastCopula": ["이었", "이였"]}
MACRO_BASES = ["플레이어", "마스터", "MASTER", "타겟", "TARGET", "조교자", "조수", "ARG"]
SAME_BASE = {"마스터": "플레이어", "MASTER": "플레이어", "TARGET": "타겟"}
BASE_NAMES = {"플레이어": "MASTER", "타겟": "TARGET", "조교자": "PLAYER", "조수": "ASSI", "ARG": "ARG"}
HELPERS = ["조사처리", "조사만처리", "조사선택", "조사만선택"]
ONLY_PARTICLE = ["조사만처리", "조사만선택"]
BOUNDARY = r"""(?=$|[\s.,!?;:)\]}>"'…。、」』）])"""
EXPRESSION = r"(?:CALLNAME(?:\s*:\s*[^%]+)?|NAME\s*:\s*[^%]+|~)"


def accepted(rule: tuple) -> list[str]:
    """All ways to name a particle."""
    key, vowel, consonant, *_, marks = rule
    with_coda = EXTRA_FORMS.get(key, [consonant])
    plain = list(dict.fromkeys([vowel, *with_coda]))
    if marks == "pass":
        return plain
    both = [f.format(a=a, b=vowel) for a in with_coda if a != vowel for f in ("{a}/{b}", "{b}/{a}", "{a}({b})", "{b}({a})", "({a}){b}", "({b}){a}")]
    return plain + both


INPUTS = {x: rule for rule in RULES for x in accepted(rule)}
BY_LENGTH = sorted(INPUTS, key=len, reverse=True)
COMPOSITE = [x for x in BY_LENGTH if set(x) & set("/()")]
PLAIN = [x for x in BY_LENGTH if not set(x) & set("/()")]
MACRO_FORMS = sorted({x for rule in RULES for x in accepted(rule) if x in PLAIN}, key=lambda x: (-len(x), x))


def any_of(values: list[str]) -> str:
    return "(?:" + "|".join(map(re.escape, values)) + ")"


POSTFIX = rf"%{EXPRESSION}%{any_of(BY_LENGTH)}"
GENERIC = rf'(?s)%{any_of(HELPERS)}\(.+?,"[^"]+"\)%'
LEGACY = rf"%{any_of(MACRO_BASES)}{any_of(MACRO_FORMS)}\([^)]*\)%"
MACRO = rf"%{any_of(MACRO_BASES)}{any_of(MACRO_FORMS)}%"


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _of(field: int, particle: Column) -> Column:
    return F.try_element_at(_table({k: str(v[field]) for k, v in INPUTS.items()}), F.trim(particle))


def call(helper: str, expression: Column, particle: Column) -> Column:
    return F.concat(F.lit(f"%{helper}("), expression, F.lit(',"'), _of(4, particle), F.lit('")%'))


def _base_expression(base: Column, named: Column) -> Column:
    return F.concat(F.when(named, "NAME:").otherwise("CALLNAME:"), F.try_element_at(_table(BASE_NAMES), base))


def occurrences(text: Column) -> Column:
    """(start, length, value, replacement, kind, output) of the patterns that ask for a particle, leftmost and longest."""

    def listed(pattern: str, kind: str, to: dict) -> Column:
        def one(m: Column) -> Column:
            new = to["new"](m["value"])
            output = F.when(new.startswith("%조사"), "function").otherwise("macro")
            return F.struct(m["start"].alias("start"), m["length"].alias("length"), m["value"].alias("value"), new.alias("replacement"), F.lit(kind).alias("kind"), output.alias("output"))

        return F.filter(F.transform(found(text, pattern), one), lambda m: m["replacement"].isNotNull())

    def postfix(v: Column) -> Column:
        own, particle = F.trim(F.regexp_extract(v, rf"^%({EXPRESSION})%", 1)), F.regexp_extract(v, r"%([^%]+)$", 1)
        return F.when(_of(6, particle) != "pass", call("조사처리", own, particle))

    def generic(v: Column) -> Column:
        parts = rf'(?s)^%({any_of(HELPERS)})\((.+?),"([^"]+)"\)%$'
        helper, own, particle = (F.regexp_extract(v, parts, k) for k in (1, 2, 3))
        return F.when(helper.isin(ONLY_PARTICLE), call("조사만처리", F.trim(own), particle)).otherwise(call("조사처리", F.trim(own), particle))

    head = rf"^%({any_of(MACRO_BASES)})({any_of(MACRO_FORMS)})"

    def macro(v: Column) -> Column:
        base, particle = F.regexp_extract(v, head + "%$", 1), F.regexp_extract(v, head + "%$", 2)
        base = F.coalesce(F.try_element_at(_table(SAME_BASE), base), base)
        short = F.concat(F.lit("%"), base, _of(3, particle), F.lit("%"))
        return F.when(_of(5, particle) == "True", short).otherwise(call("조사처리", _base_expression(base, F.lit(False)), particle))

    def legacy(v: Column) -> Column:
        pattern = head + r"\(([^)]*)\)%$"
        base, particle, given = (F.regexp_extract(v, pattern, k) for k in (1, 2, 3))
        base = F.coalesce(F.try_element_at(_table(SAME_BASE), base), base)
        named = F.trim(given) != ""
        short = F.concat(F.lit("%"), base, _of(3, particle), F.lit("%"))
        return F.when(~named & (_of(5, particle) == "True"), short).otherwise(call("조사처리", _base_expression(base, named), particle))

    every = F.concat(listed(POSTFIX, "postfix", {"new": postfix}), listed(GENERIC, "function", {"new": generic}), listed(LEGACY, "legacy", {"new": legacy}), listed(MACRO, "macro", {"new": macro}))
    return F.when(text.contains("%"), non_overlapping(every)).otherwise(F.array().cast("array<struct<start:int,length:int,value:string,replacement:string,kind:string,output:string>>"))


def summary(found_: Column) -> Column:
    """Counts of a document's occurrences, and the one kind of syntax it has (none, a kind, or mixed)."""

    def count(test) -> Column:
        return F.size(F.filter(found_, test))

    macros, functions, legacy = count(lambda m: m["output"] == "macro"), count(lambda m: m["output"] == "function"), count(lambda m: m["kind"] == "legacy")
    kinds = F.array_compact(F.array(F.when(macros > 0, "macro"), F.when(functions > 0, "function"), F.when(legacy > 0, "legacy")))
    return F.struct(
        F.size(found_).alias("patterns"),
        count(lambda m: m["kind"].isin("postfix", "legacy") | (m["value"] != m["replacement"])).alias("convertible"),
        functions.alias("functions"),
        macros.alias("macros"),
        legacy.alias("legacy"),
        (macros > 0).alias("needs_header"),
        F.when(F.size(kinds) == 0, "none").when(F.size(kinds) == 1, kinds[0]).otherwise("mixed").alias("syntax"),
    )


def coda_kind(token: Column) -> Column:
    """none, rieul or other: the final consonant of a token; digits and other letters than Hangul count by a table."""
    last = F.right(token, F.lit(1))
    index = (F.ascii(last) - 0xAC00) % 28
    return (
        F.when(F.trim(token) == "", "none")
        .when(last.rlike("^[0-9]$"), F.when(last.isin("2", "4", "5", "9"), "none").otherwise("other"))
        .when(~F.ascii(last).between(0xAC00, 0xD7A3), "other")
        .when(index == 0, "none")
        .when(index == 8, "rieul")
        .otherwise("other")
    )


def surface(particle: Column, token: Column) -> Column:
    """The form of a particle, named in any accepted way, that follows a token."""
    kind = coda_kind(token)
    return F.when((kind == "none") | ((kind == "rieul") & (_of(6, particle) == "ro")), _of(1, particle)).otherwise(_of(2, particle))


def _least_word(particle: str) -> int | None:
    """The fewest characters of a word with this plain particle that is put right; null if it is always left alone."""
    rule = INPUTS[particle]
    long = any(x == particle and len(x) > len(rule[1]) for x in EXTRA_FORMS.get(rule[0], [rule[2]]))
    return None if rule[6] == "long" and not long else len(particle) + (2 if len(particle) == 1 else 1)


def literal_particles(text: Column) -> Column:
    """A text (already without protected parts) in which particles after words have the form that the word asks for."""
    word = r"(?<![\p{L}\p{Nd}_])[가-힣0-9]+"
    composite = rf"{word}{any_of(COMPOSITE)}{BOUNDARY}"
    split = rf"^([가-힣0-9]+)({any_of(COMPOSITE)})$"

    def one(m: Column) -> Column:
        token, particle = F.regexp_extract(m, split, 1), F.regexp_extract(m, split, 2)
        with_both = F.when(particle != "", F.concat(token, surface(particle, token)))
        ending = F.coalesce(*(F.when(m.endswith(p) & (F.length(m) >= n), p) for p in PLAIN if (n := _least_word(p))))
        plain = bound(F.struct(ending.alias("p"), F.left(m, F.length(m) - F.length(ending)).alias("t")), lambda x: F.concat(x["t"], surface(x["p"], x["t"])))
        return F.coalesce(with_both, plain, m)

    return replaced(text, rf"{composite}|{word}{BOUNDARY}", one)


def rewritten(texts: DataFrame, column: str) -> DataFrame:
    """The frame with particle patterns of a text in their helper form and literal particles put right; markup is kept."""
    asked = texts.withColumn(column, replaced_at(F.col(column), occurrences(F.col(column))))
    out = placeholders.protected(asked, column, "__p")
    return out.withColumn(column, placeholders.restore(literal_particles(F.col("__p.text")), F.col("__p.placeholders"))).drop("__p")


def replaced_at(text: Column, spans: Column) -> Column:
    """The text with (start, length, replacement) put in; spans are sorted and disjoint."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        return F.struct((s["start"] + s["length"]).alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["replacement"]).alias("out"))

    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def _led(text: Column) -> tuple[Column, Column, Column]:
    """The blanks a text begins with, the particle after them (null: none), and the rest."""
    body = F.regexp_replace(text, r"^[\s\p{Z}]+", "")
    particle = F.coalesce(*(F.when(body.rlike(rf"^{re.escape(p)}{BOUNDARY}"), F.lit(p)) for p in BY_LENGTH))
    return F.left(text, F.length(text) - F.length(body)), particle, F.substring(body, F.length(particle) + 1, F.length(body))


TRAILING_EXPRESSION = rf"%({EXPRESSION})%\s*$"
TRAILING_TOKEN = r"(?<![\p{L}\p{Nd}_])([가-힣0-9]+)\s*$"


def leading_particle(previous: Column, current: Column) -> Column:
    """A text that begins with a particle of the text before it, with the form (or the helper call) that that one asks for."""
    blank, particle, rest = _led(current)
    expression = F.regexp_extract(previous, TRAILING_EXPRESSION, 1)
    token = F.regexp_extract(previous, TRAILING_TOKEN, 1)
    new = F.when(expression != "", call("조사만처리", F.trim(expression), particle)).when(token != "", surface(particle, token))
    usable = particle.isNotNull() & (_of(6, particle) != "pass") & (F.trim(previous) != "")
    return F.coalesce(F.when(usable, F.concat(blank, new, rest)), current)


def ends_in_leading(text: Column) -> Column:
    """Whether nothing follows a text's leading particle that a next one could ask for: the text ends in that particle."""
    _, particle, rest = _led(text)
    return F.coalesce(particle.isNotNull() & ~rest.rlike(TRAILING_EXPRESSION) & ~rest.rlike(TRAILING_TOKEN), F.lit(False))
