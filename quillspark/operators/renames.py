"""Renaming symbols and identifiers everywhere they occur: rename maps, edits of references, and what blocks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that a key used in code cannot hold.
UNSAFE = r"[\s\p{Z},:()\[\]{}\"%@\\+\-*/=<>!&|^~?#;']"


def rename_entries(items: DataFrame) -> DataFrame:
    """One row a (namespace, key) of items (namespace, key, new_key, number, preferred): the preferred new key, the
    keys it stands for and its numeric key; keys that do not change are left out."""
    first = F.min(F.struct(F.col("preferred").alias("p"), "new_key", "number"))
    out = items.where(F.coalesce("new_key", F.lit("")) != "").groupBy("namespace", "key").agg(first.alias("x"), F.array_sort(F.collect_set("new_key")).alias("inputs"))
    return out.select("namespace", "key", "x.new_key", "x.number", "inputs").where("key != new_key")


def replacement(new_key: Column, number: Column) -> Column:
    """The new key, or its number if the key cannot stand in code."""
    return F.when(new_key.rlike(UNSAFE) & number.isNotNull(), number.cast("string")).otherwise(new_key)


def planned_edits(references: DataFrame, entries: DataFrame) -> DataFrame:
    """Edits (document_id, start, length, value) of direct references (document_id, namespace, key, start, length)."""
    table = entries.select("namespace", "key", replacement(F.col("new_key"), F.col("number")).alias("value"))
    return references.join(table, ["namespace", "key"]).select("document_id", "start", "length", "value")


def unresolved(references: DataFrame, sites: DataFrame) -> DataFrame:
    """Indirect references of which no literal site (variable, key) is known; variables are the same in any case."""
    a = references.withColumn("__v", F.lower("variable"))
    b = sites.select(F.lower("variable").alias("__v"), "key").distinct()
    return a.join(b, ["__v", "key"], "left_anti").drop("__v")


def identifier_edits(occurrences: DataFrame, candidates: DataFrame) -> DataFrame:
    """Edits of identifier occurrences (kind, name) that have a new name."""
    return occurrences.join(candidates.select("kind", "name", F.col("new_name").alias("value")), ["kind", "name"]).select("document_id", "start", "length", "value")
