"""Protecting markup by numbered tokens, and restoring it.

Patterns are tried in order over the whole text; what an earlier pattern took, a later one cannot touch.  That order is
not the order of places, so protect is a scan in Python over Arrow batches; everything else is column expressions."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.syntax import symbol_reference

# What is protected, in order of precedence.
PATTERNS = (
    r"\\(?:\\|[%/@#nd]|[A-Za-z]+)",
    r"%[^%\r\n]+%",
    r"\{[^{}\r\n]+\}",
    r"<[^\r\n<>]+>",
    r"&(?:#\d+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);",
    r"(?<![\p{L}\p{N}_])[\p{L}_][\p{L}\p{N}_]*:\((?:[^()\r\n]|\([^()\r\n]*\))*\)",
    symbol_reference(),
    r"\[\s*\d+\s*\]",
)
_COMPILED = tuple(regex.compile(p) for p in PATTERNS)
PROTECTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("placeholders", T.ArrayType(T.StringType()))])


def protect_text(text: str, extra: str = "") -> tuple[str, list[str]]:
    taken = bytearray(len(text))
    spans = []
    for pattern in (*_COMPILED, *([regex.compile(f"[{regex.escape(extra)}]")] if extra else [])):
        for m in pattern.finditer(text):
            a, b = m.span()
            if b > a and not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                spans.append((a, b))
    spans.sort()
    parts, at = [], 0
    for i, (a, b) in enumerate(spans):
        parts += [text[at:a], f"__PH{i}__"]
        at = b
    return "".join([*parts, text[at:]]), [text[a:b] for a, b in spans]


@F.pandas_udf(PROTECTED)
def protect(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if t is None else protect_text(t) for t in text], columns=["text", "placeholders"])


def protected(rows: DataFrame, column: str, out: str) -> DataFrame:
    """The rows with a column of the protected text and its placeholders; array functions may use it, since a generator
    stands between, which keeps the optimizer from putting the Python function inside them."""
    return rows.select("*", F.explode(F.array(protect(F.col(column)))).alias(out))


def _indices(placeholders: Column) -> Column:
    return F.when(F.size(placeholders) > 0, F.sequence(F.lit(0), F.size(placeholders) - 1)).otherwise(F.array().cast("array<int>"))


def token(i: Column) -> Column:
    return F.concat(F.lit("__PH"), i.cast("string"), F.lit("__"))


def repair_tokens(text: Column, placeholders: Column) -> Column:
    """Tokens with an underscore short at either end made whole, where their number is in range."""

    def whole(a: Column, i: Column) -> Column:
        n = F.concat(F.lit(r"PH\s*0*"), i.cast("string"))
        near = F.concat(F.lit("(?<!_)(?:__"), n, F.lit("_|_"), n, F.lit("__?)(?!_)"))
        return F.regexp_replace(a, near, token(i))

    return F.aggregate(_indices(placeholders), text, whole)


def restore(text: Column, placeholders: Column) -> Column:
    return F.aggregate(_indices(placeholders), repair_tokens(text, placeholders), lambda a, i: F.replace(a, token(i), F.get(placeholders, i)))


def token_error(text: Column, placeholders: Column) -> Column:
    """null if every token is there once and in order, else count or order."""
    found = F.regexp_extract_all(text, F.lit(r"__PH\d+__"), F.lit(0))
    wanted = F.transform(_indices(placeholders), lambda i: token(i))
    return F.when(F.size(found) != F.size(wanted), "count").when(found != wanted, "order")


def apply_terms(text: str, placeholders: list[str], terms: list[tuple[str, str]]) -> tuple[str, list[str]]:
    """The text with every term outside tokens put in a new token that stands for its target, term after term."""
    out = list(placeholders)

    def put(target: str):
        def one(m: regex.Match) -> str:
            if m[1]:
                return m[0]
            out.append(target)
            return f"__PH{len(out) - 1}__"

        return one

    for source, target in terms:
        text = regex.sub(rf"(__PH\d+__)|{regex.escape(source)}", put(target), text)
    return text, out


def dictionary(entries: list[tuple[str, str]]):
    """A function of (text, placeholders) that applies a user's dictionary, longest source first; a setting, not data."""
    terms = sorted(((s, t) for s, t in entries if s.strip() and t.strip()), key=lambda x: (-len(x[0]), x[0]))

    @F.pandas_udf(PROTECTED)
    def apply(text: pd.Series, placeholders: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else apply_terms(t, list(p) if p is not None else [], terms) for t, p in zip(text, placeholders, strict=True)]
        return pd.DataFrame(rows, columns=["text", "placeholders"])

    return apply
