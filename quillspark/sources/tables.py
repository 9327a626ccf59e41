"""Segments of CSV files: which fields are text or keys, with their places, as columns over parsed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.sources.project import csv_fields, csv_kind

# First fields of character sheets, and the namespaces of their keys.
NAME_ROWS = ["呼び名", "ニックネーム", "名前", "彼氏姓", "彼氏名"]
META_ROWS = ["CSTR", "CALLNAME", "NAME"]
ROW_NAMESPACES = {
    "CSTR": "CSTR",
    "CALLNAME": "CALLNAME",
    "NAME": "NAME",
    "フラグ": "CFLAG",
    "素質": "TALENT",
    "能力": "ABL",
    "基礎": "BASE",
    "装着物": "TEQUIP",
    "汚れ": "STAIN",
    "ジュエル": "JUEL",
    "経験": "EXP",
    "刻印": "MARK",
    "欲情": "PALAM",
    "源": "SOURCE",
}


def file_namespace(document_id: Column) -> Column:
    """The stem of the file, A-Z folded, without an @ suffix; none for stems that begin with _."""
    stem = F.regexp_replace(F.substring_index(document_id, "/", -1), r"(@[0-9]+)?\.[^.]*$", "")
    return F.when(~stem.startswith("_"), F.translate(stem, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def csv_segments(docs: DataFrame) -> DataFrame:
    """(document_id, kind, segment_index, line_number, field_index, start, length, text, role, source_key, namespace,
    symbol_key, preserve_whitespace) of the fields to extract from documents (document_id, text).

    The kind of a file is that of its first line that is no comment; lines are folded per document by one window."""
    rows = docs.select("document_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "raw"))
    per_doc = Window.partitionBy("document_id").orderBy("n")
    rows = rows.withColumn("offset", F.coalesce(F.sum(F.length("raw") + 1).over(per_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    line = F.regexp_replace("raw", "\r+$", "")
    rows = rows.withColumn("fields", F.when(line.rlike(r"[^\s\p{Z}]") & ~line.rlike(r"^[\s\p{Z}]*;"), csv_fields(line)))
    first = F.first("fields", ignorenulls=True).over(per_doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("kind", csv_kind(F.col("document_id"), F.transform(first, lambda f: f["value"]))).where("fields is not null")
    head, second = F.trim(F.get("fields", F.lit(0))["value"]), F.trim(F.get("fields", F.lit(1))["value"])
    cells = rows.select("document_id", "kind", "n", "offset", head.alias("head"), second.alias("second"), F.explode("fields").alias("f")).select("*", "f.*").drop("f")
    i, value = F.col("field_index"), F.col("value")
    name = F.lower(F.substring_index("document_id", "/", -1))
    sheet, meta, names = F.col("kind") == "CharacterSheet", F.col("head").isin(META_ROWS), F.col("head").isin(NAME_ROWS)
    prose = T.contains_translatable(value) & ~T.looks_like_code_only(value) & ~T.is_numeric_like(value)
    said = F.when(prose, "value").otherwise("none")
    role = (
        F.when(name == "variablesize.csv", "none")
        .when(sheet & (i == 0), "none")
        .when(sheet & names, F.when(i == 1, said).otherwise("none"))
        .when(sheet & meta, F.when(i == 1, "meta_key").otherwise(said))
        .when(sheet, F.when(i == 1, "key").otherwise("none"))
        .when(i == 0, "key")
        .otherwise(said)
    )
    table = F.create_map(*(F.lit(x) for pair in ROW_NAMESPACES.items() for x in pair))
    own = file_namespace(F.col("document_id"))
    by_id = F.col("kind") == "IdFirst"
    key = F.when(sheet, F.col("role").isin("key", "meta_key")).otherwise(((F.col("role") == "key") & (i == 0) & ~(by_id & own.isNotNull())) | (by_id & (i == 1) & (F.col("role") == "value") & own.isNotNull()))
    space = F.when(key, F.when(sheet, F.try_element_at(table, F.col("head"))).otherwise(own))
    extract = F.when(name == "gamebase.csv", i > 0).otherwise(F.lit(True)) & (key | (F.col("role") == "value"))
    out = cells.withColumn("role", role).where("role != 'none'").where(extract).withColumn("namespace", space)
    out = out.where(~T.is_numeric_like(value) & (F.col("namespace").isNotNull() | T.contains_translatable(value)) & ~F.ltrim(value).startswith(";"))
    w = Window.partitionBy("document_id").orderBy("n", "field_index")
    return out.select(
        "document_id",
        "kind",
        (F.row_number().over(w) - 1).alias("segment_index"),
        (F.col("n") + 1).alias("line_number"),
        "field_index",
        (F.col("offset") + F.col("raw_start") + F.length("leading") + F.col("quoted").cast("int")).alias("start"),
        F.length("value").alias("length"),
        value.alias("text"),
        "role",
        F.when(sheet & meta, F.concat_ws("/", "head", "second")).otherwise(F.col("head")).alias("source_key"),
        "namespace",
        F.when(F.col("namespace").isNotNull(), F.trim(value)).alias("symbol_key"),
        (sheet & (names | meta) & (F.col("role") == "value")).alias("preserve_whitespace"),
    )
