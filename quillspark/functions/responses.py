"""What goes to and comes from a translation provider: markers for tokens, argument separators, answers in several forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.places import bound, found
from quillspark.functions.placeholders import token

# Fixed values.
ERRORS = {"configuration": "configuration error", "timeout": "timeout", "json": "JSON error", "missing_result": "missing result", "validation": "validation failed"}
META_PREFIXES = ["Final translation:", "Translated text:", "The translation is:", "Translation:", "Final answer:", "번역:", "최종 번역:"]
HELPERS = ("조사처리", "조사만처리", "조사선택", "조사만선택")
PIPE_BLOCK = r"(?ms)^\|[^\r\n|]+\|\r?\n.*?\r?\n\|\s*$"
SEGMENT_BLOCK = r"(?ms)^SEGMENT [^\r\n]+\r?\n.*?\r?\nEND SEGMENT\s*$"
THINKING = r"(?is)<think\b[^>]*>.*?</think>|<\|channel>(?:thought|analysis)\s*.*?<channel\|>\s*|</?thinking>"
ANSWERS = "array<struct<id:string,translated:string>>"


def error_label(kind: Column, status: Column) -> Column:
    """The label of a provider's error, with the HTTP status if there is one."""
    known = F.create_map(*(F.lit(x) for pair in ERRORS.items() for x in pair))
    return F.when(kind == "http", F.coalesce(F.concat(F.lit("HTTP "), status.cast("string")), F.lit("HTTP error"))).otherwise(F.coalesce(F.try_element_at(known, kind), F.lit("provider error")))


def marked(text: Column, placeholders: Column, style: str) -> Column:
    """The text with its tokens as markers that a provider leaves alone: xml (the text escaped) or word."""
    own = text
    if style == "xml":
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
            own = F.replace(own, F.lit(a), F.lit(b))

    def marker(i: Column) -> Column:
        n = i.cast("string")
        return F.concat(F.lit('<ph idx="'), n, F.lit('"/>')) if style == "xml" else F.concat(F.lit("PHTOKEN"), n, F.lit("SAFE"))

    return F.aggregate(numbers(placeholders), own, lambda a, i: F.replace(a, token(i), marker(i)))


def unmarked(text: Column, placeholders: Column, style: str) -> Column:
    """The tokens put back for their markers."""

    def one(a: Column, i: Column) -> Column:
        n = i.cast("string")
        if style != "xml":
            return F.replace(a, F.concat(F.lit("PHTOKEN"), n, F.lit("SAFE")), token(i))
        pattern = F.concat(F.lit("<ph idx=(?:\""), n, F.lit("\"|'"), n, F.lit("')(?:/>|></ph>)"))
        return F.regexp_replace(a, pattern, token(i))

    return F.aggregate(numbers(placeholders), text, one)


def numbers(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))


def _is_call(text: str, at: int) -> bool:
    head = text[:at].rstrip()
    start = len(head)
    while start and (head[start - 1].isalnum() or head[start - 1] == "_"):
        start -= 1
    name = head[start:]
    return name in HELPERS or any(c.isascii() and (c.isalpha() or c == "_") for c in name)


def _is_expression(text: str, at: int) -> bool:
    """Whether a brace holds a separator and a token, outside quotes."""
    depth, quoted, separator, word = 0, False, False, False
    for c in text[at + 1 :]:
        if c == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif c == "}" and not depth:
            break
        else:
            depth += (c == "{") - (c == "}")
            separator |= c in "、,"
            word |= c.isascii() and (c.isalnum() or c in "_:")
    return separator and word


def separated(text: str) -> str:
    """Ideographic commas as ASCII ones inside calls and brace expressions, but not in quotes."""
    if "、" not in text or not ("(" in text or "{" in text):
        return text
    out, quoted, open_ = [], False, []
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "({":
            open_.append((")" if c == "(" else "}", _is_call(text, i) if c == "(" else _is_expression(text, i)))
        elif not quoted and c in ")}" and open_ and open_[-1][0] == c:
            open_.pop()
        out.append("," if c == "、" and not quoted and any(x for _, x in open_) else c)
    return "".join(out)


@F.pandas_udf(T.StringType())
def argument_separators(text: pd.Series) -> pd.Series:
    return text.map(separated, na_action="ignore")


def without_thinking(answer: Column) -> Column:
    """An answer without the thinking around it and without a code fence."""
    own = F.trim(F.regexp_replace(answer, THINKING, ""))
    return F.when(own.rlike(r"(?s)^```[^\n]*\n.*```"), F.trim(F.regexp_extract(own, r"(?s)^```[^\n]*\n(.*)```", 1))).otherwise(own)


def translations(answer: Column, ids: Column, tokenized: bool = False) -> Column:
    """The (id, translated) that an answer gives for the ids asked for; null if it cannot be read.

    Read as blocks first where that protocol was asked for (a single id may be answered without a block), else as JSON:
    an object with translations, or an array."""

    def blocks(text: Column, pattern: str, head: str, tail: str) -> Column:
        def one(m: Column) -> Column:
            name = F.trim(F.regexp_extract(m["value"], head, 1))
            body = F.regexp_replace(F.regexp_replace(m["value"], rf"{head}\r?\n", ""), rf"\r?\n{tail}\s*$", "")
            return F.struct(name.alias("id"), F.rtrim(body).alias("translated"))

        return F.filter(F.transform(found(text, pattern), one), lambda x: x["id"] != "")

    def read(text: Column) -> Column:
        inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
        array = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
        json = F.coalesce(F.from_json(inner, "struct<translations:" + ANSWERS + ">")["translations"], F.from_json(array, ANSWERS))
        json = F.filter(json, lambda x: (F.trim(x["id"]) != "") & x["translated"].isNotNull())
        if not tokenized:
            return F.when(F.size(json) > 0, json)
        pipe = blocks(text, PIPE_BLOCK, r"^\|([^\r\n|]+)\|", r"\|")
        legacy = blocks(text, SEGMENT_BLOCK, r"^SEGMENT ([^\r\n]+)", "END SEGMENT")
        single = F.array(F.struct(F.get(ids, F.lit(0)).alias("id"), text.alias("translated")))
        plain = (F.size(ids) == 1) & (text != "") & ~text.rlike(r"^\s*[\[{]")
        return F.when(F.size(pipe) > 0, pipe).when(F.size(legacy) > 0, legacy).when(plain, single).when(F.size(json) > 0, json)

    return bound(without_thinking(answer), read)


def cleaned(value: Column) -> Column:
    """A single translation without the marks that models put around it."""
    own = F.trim(F.replace(value, F.lit("\r\n"), F.lit("\n")))
    own = F.regexp_replace(F.regexp_replace(own, r"(?s)^\|(.*)\|$", "$1"), r"\|$", "")
    prefix = "(?i)^(?:" + "|".join(META_PREFIXES) + ")"
    rest = F.trim(F.regexp_replace(own, prefix, ""))
    return F.when(rest != "", rest).otherwise(F.trim(own))


def finalized(answers: Column, ids: Column) -> Column:
    """All or nothing: the cleaned translation of every id asked for, or null if one is missing or blank."""
    table = F.map_from_entries(F.aggregate(answers, F.array().cast(ANSWERS), lambda a, x: F.concat(F.filter(a, lambda y: y["id"] != x["id"]), F.array(x))))
    rows = bound(table, lambda t: F.transform(ids, lambda i: F.struct(i.alias("id"), cleaned(F.try_element_at(t, i)).alias("translated"))))
    return bound(rows, lambda r: F.when(F.forall(r, lambda x: F.coalesce(x["translated"], F.lit("")) != ""), r))
