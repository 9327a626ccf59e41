"""Script files as logical lines, function definitions and calls."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Comment beginnings whose rest is code.
SPECIAL = (";!;", ";#;", ";^;")
LINES = "document_id string, line_number int, start int, code string"


def code_of(line: str) -> str:
    """A line with special comment marks blanked, so that places stay; a plain comment is not touched."""
    body = line.lstrip()
    return line[: len(line) - len(body)] + "   " + body[3:] if body[:3] in SPECIAL else line


def brace_depth(line: str, depth: int, quoted: bool) -> tuple[int, bool]:
    """How many braces outside quotes are open after a line, and whether a quote is, given both before it."""
    for k, part in enumerate(line.split('"')):
        quoted = quoted != (k > 0)
        if not quoted:
            for c in part:
                depth = depth + 1 if c == "{" else max(0, depth - 1) if c == "}" else depth
    return depth, quoted


DECLARES = re.compile(r"\s*#DIMS?\b", re.I)


def list_goes_on(line: str, depth: int) -> tuple[bool, int]:
    """Whether a declaration's list goes on after a line, and how many parentheses outside quotes are open then."""
    for part in line.split('"')[::2]:
        for c in part:
            depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
    return depth > 0 or line.rstrip().endswith(("=", ",")), depth


def assemble(text: str) -> Iterator[tuple[int, int, str]]:
    """(line number, place, text) of logical lines: lines with an open brace go on, and so do declarations that end with a
    comma, an equals sign or an open parenthesis; comments inside are blanked."""
    held: list[str] = []
    first = at = begin = depth = parentheses = 0
    quoted = goes_on = False
    for n, raw in enumerate(text.split("\n")):
        line = code_of(raw.rstrip("\r"))
        comment = bool(held) and line.lstrip().startswith(";")
        line = " " * len(line) if comment else line
        if not held:
            first, begin, depth, parentheses, quoted = n, at, 0, 0, False
        held.append(line + " " * (len(raw) - len(raw.rstrip("\r"))))
        at += len(raw) + 1
        depth, quoted = brace_depth(line, depth, quoted)
        if not comment:
            goes_on, parentheses = list_goes_on(line, parentheses) if DECLARES.match(held[0]) else (False, 0)
        if not (depth or goes_on) or held[0].lstrip().startswith(";"):
            yield first, begin, "\n".join(held).rstrip(" ") if len(held) == 1 else "\n".join(held)
            held = []
    if held:
        yield first, begin, "\n".join(held)


def logical_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(document_id, line_number, start, code); documents are read whole, one after the other."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(d, *x) for d, t in zip(part["document_id"], part["t"], strict=True) if t is not None for x in assemble(t)]
            yield pd.DataFrame(rows, columns=["document_id", "line_number", "start", "code"])

    return docs.select("document_id", F.col(text_col).alias("t")).mapInPandas(run, LINES)


def without_comment(code: Column) -> Column:
    """The code before a semicolon outside quotes."""
    return F.regexp_extract(code, r'^((?:[^";\n]|"[^"\n]*"?)*+)', 1)


def unquoted(code: Column) -> Column:
    return F.regexp_replace(code, r'"[^"\n]*"?', '""')


def functions(lines: DataFrame) -> DataFrame:
    """(name) of every function defined by @name or called as name(...) outside quotes and print lines, upper-cased."""
    own = lines.select(without_comment(F.col("code")).alias("c"))
    defined = own.select(F.regexp_extract("c", r"^\s*@([\p{L}_][\p{L}\p{N}_]*)", 1).alias("name"))
    calls = own.where(~F.col("c").rlike(r"(?i)^\s*PRINT(?!.*FORM)")).select(F.explode(F.regexp_extract_all(unquoted(F.col("c")), F.lit(r"([\p{L}_][\p{L}\p{N}_]*)\s*\("), F.lit(1))).alias("name"))
    return defined.union(calls).where("name != ''").select(F.upper("name").alias("name")).distinct()


def print_texts(lines: DataFrame) -> DataFrame:
    """(document_id, line_number, start, length, text) of what print commands put out, with exact places."""
    pattern = r"^(\s*(?:PRINT(?:SINGLE)?(?:FORM)?[LWDK]*|DATAFORM|DATA)[ \t])([^\r\n]+)"
    head, tail = F.regexp_extract("code", pattern, 1), F.regexp_extract("code", pattern, 2)
    return lines.where(tail != "").select("document_id", "line_number", (F.col("start") + F.length(head)).alias("start"), F.length(tail).alias("length"), tail.alias("text"))


def namespaces(listing: DataFrame, built_in: list[str]) -> DataFrame:
    """(namespace) of built-in names and of the stems of CSV files, A-Z folded only, without @ suffix; _ names are out."""
    stem = F.regexp_replace(F.substring_index("document_id", "/", -1), r"(@[0-9]+)?\.[^.]*$", "")
    own = listing.where("file_type = 'csv'").select(F.translate(stem, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("namespace"))
    fixed = listing.sparkSession.createDataFrame([(x,) for x in built_in], "namespace string")
    return own.where("not startswith(namespace, '_')").union(fixed).distinct()
