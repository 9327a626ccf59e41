"""Scripts, tables and texts made from the rows of a table, with what is to be found in them known beforehand.

A line is a template: @w is a word and @n the number of the row.  The same templates fill the Spark frames and the SQL,
so the SQL states what the lines hold without reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.plans.shared import dealt

WORDS = ["薬草", "水筒", "記録", "花束", "地図", "手紙", "時計", "宝石"]


def word(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WORDS)), (number % len(WORDS) + 1).cast("int"))


def filled(template: str, number: Column) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("@w"), word(number)), F.lit("@n"), number.cast("string"))


def quoted(value: str) -> str:
    """An SQL string; line ends and tabs as functions."""
    own = "'" + value.replace("'", "''") + "'"
    for c in "\n\r\t":
        own = own.replace(c, f"' || chr({ord(c)}) || '")
    return f"({own})"


def filled_sql(template: str, number: str) -> str:
    words = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
    return f"replace(replace({quoted(template)}, '@w', {words}[{number} % {len(WORDS)} + 1]), '@n', CAST({number} AS VARCHAR))"


def chosen(templates: list[str], number: Column) -> Column:
    """The text of the template that the number points to."""
    return F.element_at(F.array(*(filled(t, number) for t in templates)), (number % len(templates) + 1).cast("int"))


def chosen_sql(templates: list[str], number: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {filled_sql(t, number)}" for k, t in enumerate(templates))
    return f"CASE {number} % {len(templates)} {cases} END"


def scripts(rows: DataFrame, number: str, lines: list[str]) -> DataFrame:
    """(document_id, text): a script of the lines for each row."""
    n = F.col(number)
    return dealt(rows.select(n), number).select(n.cast("string").alias("document_id"), F.concat_ws("\n", *(filled(x, n) for x in lines)).alias("text"))


def places_sql(lines: list[str], number: str, table: str, expected: list[tuple[int, str, str, dict[str, str]]]) -> str:
    """Rows (document_id, line_number, start, length, ...) of what is expected: line, what is before it, it, columns."""

    def row(line: int, before: str, value: str, more: dict[str, str]) -> str:
        offset = " + ".join([f"length({filled_sql(x, number)}) + 1" for x in lines[:line]] + [f"length({filled_sql(before, number)})"])
        columns = ", ".join(f"{v.replace('@value', filled_sql(value, number))} AS {k}" for k, v in more.items())
        return f"SELECT CAST({number} AS VARCHAR) AS document_id, {line} AS line_number, CAST({offset} AS INTEGER) AS start, CAST(length({filled_sql(value, number)}) AS INTEGER) AS length, {columns} FROM {table}"

    return " UNION ALL ".join(row(*x) for x in expected)
