"""Filters, orders and set operations on items, as an interactive view uses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import text_match
from quillspark.operators.grouping import keep_first


def matching(items: DataFrame, fields: list[str], query: str = "", regex: bool = False, file_type: str | None = None, status: str | None = None, warnings_only: bool = False) -> DataFrame:
    """Items of a type and status with the query in one of the fields; every setting that is not given passes all."""
    keep = F.lit(True)
    if file_type is not None:
        keep = keep & (F.col("file_type") == file_type)
    if status is not None:
        keep = keep & F.col("status").contains(status)
    if warnings_only:
        keep = keep & (F.coalesce("warning", F.lit("")) != "")
    if query.strip():
        hit = F.lit(False)
        for f in fields:
            hit = hit | text_match(F.col(f).cast("string"), query, regex)
        keep = keep & hit
    return items.where(keep)


def replaced(items: DataFrame, field: str, old: str, new: str, regex: bool = False) -> DataFrame:
    """The items with a text replaced, whatever its case, in a field, and whether that changed it."""
    pattern = old if regex else "\\Q" + old.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    text = F.regexp_replace(F.col(field), f"(?i){pattern}", new if regex else new.replace("\\", "\\\\").replace("$", "\\$"))
    return items.withColumn("changed", F.coalesce(text != F.col(field), F.lit(False))).withColumn(field, text)


def in_order(items: DataFrame, field: str, order: list[str], *then: Column) -> DataFrame:
    """The items by the place of a field's value in a list (others last), then by the rest."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(field))
    return items.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), *then)


def repeated_keys(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, messages): one message for every repeat of a key."""
    return items.groupBy(*keys).agg((F.count("*") - 1).alias("messages")).where("messages > 0")


def union_first_wins(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"))


def union_first(first: DataFrame, second: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key of both sides: of the first side if it has the key, then the first in order."""
    both = first.withColumn("__side", F.lit(0)).unionByName(second.withColumn("__side", F.lit(1)))
    return keep_first(both, keys, [F.col("__side"), *order]).drop("__side")


def except_keys(items: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(gone.select(*keys), keys, "left_anti")


def latest(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n first rows of an order: a top-k report."""
    return rows.orderBy(*order).limit(n)
