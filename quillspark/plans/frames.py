"""Frames of the engine's data model over the standard tables, each with the same frame in DuckDB SQL.

A document is a source file, its lines are segments; parts are symbols, customers are users, suppliers projects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that hold text, as items."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("line_number", "original_text")).where(F.col("original_text").rlike(r"[^\p{Zs}]"))
    return rows.select(
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line_number").cast("string")).alias("segment_id"),
        F.concat("source", F.lit("\\"), F.col("doc_id").cast("string"), F.lit(".erb")).alias("relative_path"),
        F.when(F.col("line_number") % 3 == 0, "print").otherwise("data").alias("segment_type"),
        "line_number",
        "original_text",
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("k"), F.col("line_number").cast("string"))).alias("source_key"),
        F.when(F.col("doc_id") % 4 == 0, F.col("line_number") % 2).alias("field_index"),
        F.lit("value").alias("field_role"),
        F.when(F.col("doc_id") % 4 == 1, F.col("lang")).alias("symbol_namespace"),
        F.when(F.col("doc_id") % 4 == 1, F.substring("original_text", 1, 12)).alias("symbol_key"),
        "doc_id",
    )


SEGMENTS = r"""
segments AS (
  SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(n AS VARCHAR) AS segment_id, source || '\' || CAST(doc_id AS VARCHAR) || '.erb' AS relative_path,
         CASE WHEN n % 3 = 0 THEN 'print' ELSE 'data' END AS segment_type, CAST(n AS INTEGER) AS line_number, t AS original_text,
         CASE WHEN doc_id % 4 = 0 THEN 'k' || CAST(n AS VARCHAR) END AS source_key, CASE WHEN doc_id % 4 = 0 THEN n % 2 END AS field_index,
         'value' AS field_role, CASE WHEN doc_id % 4 = 1 THEN lang END AS symbol_namespace,
         CASE WHEN doc_id % 4 = 1 THEN substr(t, 1, 12) END AS symbol_key, doc_id
  FROM (SELECT doc_id, source, lang, i - 1 AS n, l[i] AS t
        FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(generate_series(1, len(l))) s(i))
  WHERE trim(t) <> '')
"""


def previous(items: DataFrame) -> DataFrame:
    """An earlier snapshot: half of the files kept, a quarter with lines moved down, some ids and keys changed."""
    kind = F.col("doc_id") % 8
    moved = F.when(kind.isin(4, 5, 6), F.col("line_number") + 1).otherwise(F.col("line_number"))
    new_id = F.concat_ws(":", F.col("doc_id").cast("string"), moved.cast("string"))
    out = items.where("doc_id % 16 != 7").withColumn("segment_id", F.when(kind == 3, F.concat(F.lit("old-"), new_id)).otherwise(new_id)).withColumn("line_number", moved)
    return out.withColumn("relative_path", F.when(kind == 2, F.upper("relative_path")).when(kind == 3, F.lit("gone.erb")).otherwise(F.col("relative_path")))


PREVIOUS = r"""
previous AS (
  SELECT CASE WHEN doc_id % 8 = 3 THEN 'old-' ELSE '' END || CAST(doc_id AS VARCHAR) || ':' || CAST(line_number + CASE WHEN doc_id % 8 IN (4, 5, 6) THEN 1 ELSE 0 END AS VARCHAR) AS segment_id,
         CASE WHEN doc_id % 8 = 2 THEN upper(relative_path) WHEN doc_id % 8 = 3 THEN 'gone.erb' ELSE relative_path END AS relative_path,
         segment_type, line_number + CASE WHEN doc_id % 8 IN (4, 5, 6) THEN 1 ELSE 0 END AS line_number, original_text, source_key, field_index, field_role, symbol_namespace, symbol_key, doc_id
  FROM segments WHERE doc_id % 16 <> 7)
"""


def progress(items: DataFrame) -> DataFrame:
    """States of the items of a snapshot."""
    n = F.length("original_text")
    status = F.when(n % 5 == 0, "PENDING").when(n % 5 == 1, "NEEDS_REVIEW").otherwise("DONE")
    return items.select("segment_id", status.alias("status"), (n % 7 != 0).alias("can_save"), F.when(n % 5 != 0, F.concat(F.lit("tr "), F.reverse("original_text"))).alias("translated_text"))


PROGRESS = r"""
progress AS (
  SELECT segment_id, CASE WHEN length(original_text) % 5 = 0 THEN 'PENDING' WHEN length(original_text) % 5 = 1 THEN 'NEEDS_REVIEW' ELSE 'DONE' END AS status,
         length(original_text) % 7 <> 0 AS can_save, CASE WHEN length(original_text) % 5 <> 0 THEN 'tr ' || reverse(original_text) END AS translated_text
  FROM previous)
"""
