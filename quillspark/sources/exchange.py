"""Other ways in and out: lexicons in XML, paired dictionary lines, sessions in JSON and SQLite, exports of text."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.rules import tag_priority
from quillspark.sources.project import BOMS, encoded

# What a project needs of its particle package.
REQUIRED_FUNCTIONS = ["조사처리", "조사만처리"]


ENTRY = "k_ele array<struct<keb:string,ke_pri:array<string>>>, r_ele array<struct<reb:string,re_pri:array<string>>>, sense array<struct<pos:array<string>>>, trans array<struct<name_type:array<string>>>"


def entry_lists(rows: DataFrame) -> DataFrame:
    """(surfaces, readings, tags, kinds) of parsed entries, without blanks and repeats."""

    def listed(*columns: Column) -> Column:
        none = F.array().cast("array<string>")
        every = F.concat(*(F.coalesce(c, none) for c in columns))
        return F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != "")

    tags = listed(F.flatten(F.filter("k_ele.ke_pri", lambda x: x.isNotNull())), F.flatten(F.filter("r_ele.re_pri", lambda x: x.isNotNull())))
    kinds = listed(F.flatten(F.filter("sense.pos", lambda x: x.isNotNull())), F.flatten(F.filter("trans.name_type", lambda x: x.isNotNull())))
    return rows.select(F.array_distinct(listed(F.col("k_ele.keb"))).alias("surfaces"), F.array_distinct(listed(F.col("r_ele.reb"))).alias("readings"), tags.alias("tags"), F.array_distinct(kinds).alias("kinds"))


def xml_entries(texts: DataFrame, xml: str) -> DataFrame:
    """Entries in a column of XML, one each."""
    return entry_lists(texts.select(F.from_xml(F.col(xml), ENTRY).alias("e")).select("e.*"))


def read_lexicon(spark: SparkSession, path: str, row_tag: str = "entry") -> DataFrame:
    """Entries of (gzipped) XML files, split by Spark's own source."""
    return entry_lists(spark.read.format("xml").option("rowTag", row_tag).schema(ENTRY).load(path))


def lexicon_terms(entries: DataFrame, is_name: bool, source: str) -> DataFrame:
    """(surface, reading, priority, kinds, is_name, source): every surface with every reading; a reading stands for a
    surface where there is none.  Equal rows are one, of the greatest priority."""
    forms = F.when(F.size("surfaces") > 0, F.col("surfaces")).otherwise(F.col("readings"))
    readings = F.when(F.size("readings") > 0, F.col("readings")).otherwise(F.array(F.lit("")))
    out = entries.select(F.explode(forms).alias("surface"), readings.alias("r"), tag_priority(F.col("tags")).alias("priority"), F.array_join("kinds", "|").alias("kinds"))
    out = out.select("surface", F.explode("r").alias("reading"), "priority", "kinds")
    out = out.groupBy("surface", "reading", "kinds").agg(F.max("priority").alias("priority"))
    return out.select("surface", "reading", "priority", "kinds", F.lit(is_name).alias("is_name"), F.lit(source).alias("source"))


def overridden(terms: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """The terms with the target of the override of greatest priority for their surface or reading."""
    best = overrides.groupBy(key).agg(F.max(F.struct("priority", "target")).alias("o")).select(key, F.col("o.target").alias("target"))
    return terms.join(best, key, "left")


def paired_lines(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, source, target) of dictionaries whose lines are sources and targets in turn, between blank or comment lines.

    A dictionary is quoted if at least half of its lines are in quotes; then only those count.  A source without a
    target before the next boundary is skipped."""
    own = lines.select(key, order, F.trim(F.regexp_replace(line, "\r$", "")).alias("t"))
    boundary = (F.col("t") == "") | F.col("t").startswith(";") | F.col("t").startswith("[")
    own = own.withColumn("b", boundary.cast("int")).withColumn("q", F.col("t").rlike('^".*"$') & ~boundary)
    kind = own.where("b = 0").groupBy(key).agg((F.count_if("q") * 2 >= F.count("*")).alias("quoted"))
    w = Window.partitionBy(key).orderBy(order)
    own = own.withColumn("island", F.sum("b").over(w)).join(kind, key).where("b = 0 and (q or not quoted)")
    inner = Window.partitionBy(key, "island").orderBy(order)
    text = F.when(F.col("quoted"), F.regexp_extract("t", '^"(.*)"$', 1)).otherwise(F.col("t"))
    own = own.withColumn("n", F.row_number().over(inner)).withColumn("source", text).withColumn("target", F.lead(text).over(inner))
    return own.where("n % 2 = 1 and target is not null").select(key, "source", "target")


def dictionary_lines(entries: DataFrame, modes: dict[str, str], enabled: dict[bool, str]) -> DataFrame:
    """(value): one tab-separated line an entry (source, target, mode, is_enabled), with backslash escapes."""

    def safe(c: str) -> Column:
        return F.replace(F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))

    mode = F.try_element_at(F.create_map(*(F.lit(x) for pair in modes.items() for x in pair)), F.col("mode"))
    return entries.select(F.concat_ws("\t", safe("source"), safe("target"), mode, F.when(F.col("is_enabled"), enabled[True]).otherwise(enabled[False])).alias("value"))


def session_items(texts: DataFrame, json_text: str, schema: str) -> DataFrame:
    """The items of sessions in JSON: an object with documents, each with items; other columns are kept."""
    rest = [c for c in texts.columns if c != json_text]
    parsed = F.from_json(F.col(json_text), f"struct<documents:array<struct<document_id:string,items:array<{schema}>>>>")
    documents = texts.select(*rest, F.explode(parsed["documents"]).alias("d"))
    return documents.select(*rest, "d.document_id", F.inline("d.items"))


def sqlite_rows(files: DataFrame, table: str, schema: str) -> DataFrame:
    """(path, columns of ``schema``) of a table of SQLite files (path, content); each file is read where it lies."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                db.row_factory = sqlite3.Row
                rows += [(path, json.dumps(dict(r), ensure_ascii=False)) for r in db.execute(f'SELECT * FROM "{table}"')]
                db.close()
            yield pd.DataFrame(rows, columns=["path", "row"])

    out = files.select("path", "content").mapInPandas(run, "path string, row string")
    return out.select("path", F.from_json("row", schema).alias("r")).select("path", "r.*")


def support_package(documents: DataFrame, required: list[str] | None = None) -> DataFrame:
    """One row of what documents (project, document_id, text) have of the particle package, by project."""
    name = F.upper(F.substring_index("document_id", "/", -1))
    need = REQUIRED_FUNCTIONS if required is None else required
    script = name == "ZNAME.ERB"
    return documents.groupBy("project").agg(
        F.coalesce(F.bool_or(script), F.lit(False)).alias("has_script"),
        F.coalesce(F.bool_or(name == "ZNAME.ERH"), F.lit(False)).alias("has_header"),
        *(F.coalesce(F.bool_or(script & F.col("text").contains(x)), F.lit(False)).alias(f"has_{k}") for k, x in enumerate(need)),
        F.coalesce(F.bool_or(F.col("text").rlike(r"(?im)^\s*#INCLUDE\b.*ZNAME")), F.lit(False)).alias("linked"),
    )


def as_utf8(documents: DataFrame) -> DataFrame:
    """(document_id, content): documents in a legacy encoding as UTF-8 with a byte-order mark; others are left out."""
    legacy = ~F.col("encoding").isin("utf-8", *BOMS)
    return documents.where(legacy).select("document_id", encoded("text", F.lit("utf-8-sig")).alias("content"))
