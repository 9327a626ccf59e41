"""Queries of operators on items over the standard tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import carry_over as C
from quillspark.operators import items as M
from quillspark.operators import selection as S
from quillspark.plans.frames import SEGMENTS, segments, table
from quillspark.plans.generated import filled, filled_sql, scripts
from quillspark.plans.queries import query
from quillspark.plans.script_queries import SYMBOLS
from quillspark.sources import script, symbols

N = "p_partkey"
_STATES = ["TRANSLATING", "DONE", "EXCLUDED", "VALIDATION_FAILED", "FAILED"]


@query(f"""WITH s AS (SELECT {N} AS segment_id, ['TRANSLATING', 'DONE', 'EXCLUDED', 'VALIDATION_FAILED', 'FAILED'][{N} % 5 + 1] AS st, CASE WHEN {N} % 7 > 0 THEN p_name ELSE ' ' END AS tr FROM part WHERE {N} % 3 > 0)
  SELECT p.{N} AS segment_id, CASE WHEN st IS NULL THEN 'PENDING' WHEN st IN ('DONE', 'VALIDATION_FAILED') AND trim(tr) = '' THEN 'FAILED' WHEN st = 'TRANSLATING' THEN 'STOPPED' WHEN st = 'VALIDATION_FAILED' THEN 'NEEDS_REVIEW' ELSE st END AS status,
    CASE WHEN st IN ('DONE', 'VALIDATION_FAILED') AND trim(tr) = '' THEN 'BLANK' WHEN st IS NULL OR st = 'TRANSLATING' THEN 'UNCHECKED' ELSE 'PASS' END AS validation,
    coalesce(CASE WHEN st IN ('DONE', 'VALIDATION_FAILED') AND trim(tr) = '' THEN FALSE WHEN st = 'TRANSLATING' THEN FALSE WHEN st = 'EXCLUDED' THEN TRUE ELSE {N} % 2 = 0 END, FALSE) AND st IS NOT NULL AS can_save,
    CASE WHEN st IS NULL OR (st IN ('DONE', 'VALIDATION_FAILED') AND trim(tr) = '') THEN '' ELSE tr END AS translated_text
  FROM part p LEFT JOIN s ON s.segment_id = p.{N}""")
def restored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, rows = F.col(N), table(spark, sf_dir, "part")
    status = F.element_at(F.array(*map(F.lit, _STATES)), (n % 5 + 1).cast("int"))
    progress = rows.where(n % 3 > 0).select(n.alias("segment_id"), status.alias("status"), F.lit("PASS").alias("validation"), (n % 2 == 0).alias("can_save"), F.when(n % 7 > 0, F.col("p_name")).otherwise(" ").alias("translated_text"))
    return M.restored(rows.select(n.alias("segment_id")), progress)


@query(f"""WITH {SEGMENTS}, i AS (SELECT segment_id, trim(original_text) AS t, relative_path, line_number, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 't' || CAST(doc_id AS VARCHAR) END AS tr, CASE WHEN doc_id % 10 = 0 THEN 'EXCLUDED' ELSE 'DONE' END AS st, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 4 END AS pr FROM segments),
  b AS (SELECT t, arg_min(tr, (pr, 0, relative_path, line_number, segment_id)) FILTER (pr IS NOT NULL AND tr <> '') AS new FROM i GROUP BY 1 HAVING count(*) > 1)
  SELECT segment_id, CASE WHEN new IS NOT NULL AND st <> 'EXCLUDED' THEN new ELSE tr END AS translated_text, CASE WHEN new IS NOT NULL AND st <> 'EXCLUDED' AND new <> tr THEN 'MANUAL' ELSE st END AS status FROM i LEFT JOIN b USING (t)""")
def corrected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    items = segments(spark, sf_dir).select("segment_id", "original_text", "relative_path", "line_number", F.when(d % 3 == 0, "").otherwise(F.concat(F.lit("t"), d.cast("string"))).alias("translated_text"), F.when(d % 10 == 0, "EXCLUDED").otherwise("DONE").alias("status"), F.when(d % 4 > 0, d % 4).alias("priority"))
    return M.corrected(items, F.col("priority"), F.lit(0)).select("segment_id", "translated_text", "status")


@query(f"""SELECT {N}, CASE WHEN {N} % 2 = 0 THEN replace({filled_sql("가 @w", N)}, '가', '나') ELSE '다' END AS translated_text, CASE WHEN {N} % 2 = 0 THEN 'FAILED' ELSE 'DONE' END AS status FROM part""")
def bulk_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text replaced everywhere; translations that still hold the source language then fail."""
    n = F.col(N)
    items = table(spark, sf_dir, "part").select(n, filled("@w", n).alias("original_text"), F.when(n % 2 == 0, filled("가 @w", n)).otherwise("다").alias("translated_text"), F.lit("DONE").alias("status"))
    return M.bulk_replaced(items, "가", "나", "ja", "ko").select(N, "translated_text", "status")


@query("""SELECT c_custkey AS segment_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def scoped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    visible = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("segment_id"))
    return M.scoped(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("segment_id")), visible)


@query("""WITH l AS (SELECT 's' || CAST(p_size AS VARCHAR) AS surface, 'r' || CAST(p_size % 7 AS VARCHAR) AS reading, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS target, p_partkey % 2 = 0 AS is_name, p_size AS priority, p_partkey AS row_id FROM part),
  a AS (SELECT surface AS t, target FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY target = '', is_name, priority DESC, row_id) AS n FROM l) WHERE n = 1),
  b AS (SELECT reading AS t, target FROM (SELECT *, row_number() OVER (PARTITION BY reading ORDER BY target = '', is_name, priority DESC, row_id) AS n FROM l) WHERE n = 1),
  q AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 's' || CAST(c_custkey % 60 AS VARCHAR) ELSE 'r' || CAST(c_custkey % 9 AS VARCHAR) END AS t FROM customer)
  SELECT c_custkey, coalesce(a.target, b.target) AS target, CASE WHEN a.t IS NOT NULL THEN 'surface' WHEN b.t IS NOT NULL THEN 'reading' END AS tier FROM q LEFT JOIN a USING (t) LEFT JOIN b USING (t)""")
def lexicon_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("surface"), F.concat(F.lit("r"), (F.col("p_size") % 7).cast("string")).alias("reading"), F.when(F.col(N) % 3 == 0, "").otherwise(F.col("p_name")).alias("target"), (F.col(N) % 2 == 0).alias("is_name"), F.col("p_size").alias("priority"), F.col(N).alias("row_id"))
    k = F.col("c_custkey")
    terms = table(spark, sf_dir, "customer").select(k, F.when(k % 2 == 0, F.concat(F.lit("s"), (k % 60).cast("string"))).otherwise(F.concat(F.lit("r"), (k % 9).cast("string"))).alias("term"))
    return M.looked_up(terms, "c_custkey", "term", lexicon)


@query(f"""SELECT {N} FROM part WHERE {N} % 32 & 6 <> 0 AND p_size % 2 = 1 AND upper(substr(p_name, 1, 1)) IN (SELECT DISTINCT unnest(string_split(c_mktsegment, '')) FROM customer)""")
def eligible_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "part").select(N, F.upper(F.substring("p_name", 1, 1)).alias("first_char"), (F.col(N) % 32).alias("mask"), (F.col("p_size") % 2).alias("version"))
    return M.eligible_hints(entries, table(spark, sf_dir, "customer"), "c_mktsegment", 6, 1).select(N)


@query("""WITH RECURSIVE d AS (SELECT o_custkey AS g, o_orderkey AS k, o_orderstatus || CAST(o_orderkey % 5 AS VARCHAR) AS t, CAST(o_orderkey % 200 AS BIGINT) AS s FROM orders),
  u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, t ORDER BY k) AS n FROM d) WHERE n = 1),
  r AS (SELECT g, k, s, row_number() OVER (PARTITION BY g ORDER BY k) AS i FROM u),
  f AS (SELECT g, k, i, s <= 360 AS kept, CASE WHEN s <= 360 THEN 1 ELSE 0 END AS n, CASE WHEN s <= 360 THEN s ELSE 0 END AS u FROM r WHERE i = 1
    UNION ALL SELECT r.g, r.k, r.i, f.n < 4 AND f.u + r.s <= 360, f.n + CASE WHEN f.n < 4 AND f.u + r.s <= 360 THEN 1 ELSE 0 END, f.u + CASE WHEN f.n < 4 AND f.u + r.s <= 360 THEN r.s ELSE 0 END FROM f JOIN r ON r.g = f.g AND r.i = f.i + 1)
  SELECT g, k FROM f WHERE kept""")
def budgeted_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("k"), F.concat("o_orderstatus", (F.col("o_orderkey") % 5).cast("string")).alias("t"), (F.col("o_orderkey") % 200).alias("s"))
    return M.budgeted_targets(rows, "g", [F.col("k")], "s", "t", 4, 360).select("g", "k")


@query("""SELECT conv_id, turn, lag(CASE WHEN role <> 'system' AND turn % 3 <> 1 THEN text END) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations""")
def previous_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return M.previous_values(rows, "conv_id", "turn", "text", (F.col("role") == "system") | (F.col("turn") % 3 == 1)).select("conv_id", "turn", "previous")


_V, _W = filled_sql("乙@n", N), filled_sql("@w", N)
_AT = f"length({filled_sql(SYMBOLS[0], N)}) + 1 + length({filled_sql(SYMBOLS[1], N)}) + 1"


@query(f"""SELECT CAST({N} AS VARCHAR) AS document_id, CAST(length({filled_sql(SYMBOLS[0], N)}) + 1 + length('LOCALS = "') AS INTEGER) AS start, CAST(length({_W}) AS INTEGER) AS length, '새' || {_W} AS value FROM part
  UNION ALL SELECT CAST({N} AS VARCHAR), CAST({_AT} + length('ARGS = A ? "') AS INTEGER), 1, '새甲' FROM part""")
def indirect_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys renamed where variables get them: the literals of LOCALS for TALENT, one of those of ARGS for BASE."""
    lines = script.logical_lines(scripts(table(spark, sf_dir, "part"), N, SYMBOLS))
    words = table(spark, sf_dir, "part").select(filled("@w", F.col(N)).alias("key")).distinct()
    renames = words.select(F.lit("TALENT").alias("namespace"), "key").union(spark.createDataFrame([("BASE", "甲")], "namespace string, key string")).withColumn("value", F.concat(F.lit("새"), "key"))
    edits, _ = M.indirect_edits(symbols.references(lines), symbols.variable_literals(lines), renames)
    return edits


@query("""SELECT 'TALENT' AS namespace, 'none' AS key, 'review' AS state WHERE FALSE UNION ALL SELECT 'BASE', '甲', 'review'""")
def renames_for_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames of keys that a variable of several values, or an unresolved reference, may mean."""
    lines = script.logical_lines(scripts(table(spark, sf_dir, "part"), N, SYMBOLS))
    renames = spark.createDataFrame([("BASE", "甲", "새")], "namespace string, key string, value string")
    return M.indirect_edits(symbols.references(lines), symbols.variable_literals(lines), renames)[1]


@query(f"""SELECT count(*) AS documents, sum(CASE WHEN {N} % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS warnings, sum({N} % 3)::BIGINT AS particle_patterns, count(*) AS items, count(*) FILTER ({N} % 5 <> 0 AND {N} % 2 = 0) AS script_items, count(*) FILTER ({N} % 5 <> 0 AND {N} % 2 = 1) AS csv_items, count(*) FILTER ({N} % 5 = 0) AS identifier_items FROM part""")
def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, rows = F.col(N), table(spark, sf_dir, "part")
    documents = rows.select(F.when(n % 4 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")).alias("warnings"), (n % 3).alias("patterns"))
    return M.scan_metrics(documents, rows.select(F.when(n % 5 == 0, "identifier-function").otherwise("print").alias("segment_type"), F.when(n % 2 == 1, "csv").otherwise("script").alias("file_type")))


@query("""SELECT l_orderkey AS submission_id, count(*) FILTER (l_quantity < 10) AS applied, count(*) FILTER (l_quantity >= 10 AND l_quantity < 20) AS noop, count(*) FILTER (l_quantity >= 20 AND l_quantity < 30) AS conflict, count(*) FILTER (l_quantity >= 30) AS rejected FROM lineitem GROUP BY 1""")
def submission_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("submission_id"), F.when(q < 10, "Applied").when(q < 20, "NoOp").when(q < 30, "Conflict").otherwise("Rejected").alias("result"))
    return M.outcome_counts(rows, "submission_id")


@query("""SELECT c_custkey, sha256('{"base_revision":' || CAST(c_nationkey AS VARCHAR) || ',"id":"' || c_name || '","translation":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"번역 ' || c_mktsegment || '"' END || '}') AS hash FROM customer""")
def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"translation": F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("번역 "), "c_mktsegment")), "id": F.col("c_name"), "base_revision": F.col("c_nationkey")}
    return table(spark, sf_dir, "customer").select("c_custkey", M.canonical_hash(fields).alias("hash"))


@query(f"""SELECT {N}, CASE WHEN {N} % 3 = 0 THEN p_type WHEN {N} % 3 = 1 THEN 'mean ' || p_type END AS target, CASE WHEN {N} % 3 = 0 THEN 'r' WHEN {N} % 3 = 1 THEN '' END AS reading FROM part""")
def dictionary_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved answers of an online dictionary: an array of entries, one object, or a page that is none."""
    n = F.col(N)
    one = F.to_json(F.struct(F.col("p_name").alias("surface"), F.col("p_type").alias("koTarget"), F.lit("r").alias("reading")))
    other = F.to_json(F.struct(F.lit("other").alias("surface"), F.lit("x").alias("koTarget")))
    single = F.to_json(F.struct(F.col("p_name").alias("headword"), F.concat(F.lit("mean "), "p_type").alias("mean")))
    payload = F.when(n % 3 == 0, F.concat(F.lit("["), other, F.lit(","), one, F.lit("]"))).when(n % 3 == 1, single).otherwise("<html>")
    out = table(spark, sf_dir, "part").select(N, M.dictionary_payload(F.col("p_name"), payload).alias("x"))
    return out.select(N, F.col("x.target").alias("target"), F.col("x.reading").alias("reading"))


@query("""SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY s, v) AS n FROM (SELECT c_nationkey AS k, c_name AS v, 0 AS s FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier)) WHERE n = 1""")
def first_of_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union where the first row of a key counts, repeats within one side as well."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k"), F.col("c_name").alias("v"))
    return S.union_first(a, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), ["k"], [F.col("v")])


@query("""SELECT p_partkey, FALSE AS bad, contains(lower(p_name), 'a') AS good FROM part""")
def pattern_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that is none matches nothing; a good one matches whatever its case."""
    rows = table(spark, sf_dir, "part")
    return rows.select(N, T.text_match(F.col("p_name"), "(", regex=True).alias("bad"), T.text_match(F.col("p_name"), "A", regex=True).alias("good"))


@query(f"""SELECT {N} AS segment_id, {N} AS previous_id, p_type AS translated_text FROM part WHERE {N} % 4 IN (0, 1)""")
def renamed_key_restores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys restored whose files hold their translation already; others must have the same text and key."""
    n, rows = F.col(N), table(spark, sf_dir, "part")
    fixed = {"relative_path": F.lit("a"), "segment_type": F.lit("t"), "source_key": F.lit(None).cast("string"), "field_index": F.lit(0), "field_role": F.lit("key"), "symbol_namespace": F.lit("ITEM")}

    def snapshot(text, reference):
        return rows.select(n.alias("segment_id"), *(v.alias(k) for k, v in fixed.items()), text.alias("original_text"), text.alias("symbol_key"), reference.alias("is_reference_key"))

    now = F.when(n % 4 == 0, F.col("p_name")).when(n % 4 == 3, F.col("p_brand")).otherwise(F.col("p_type"))
    return C.exact(snapshot(now, n % 4 != 2), snapshot(F.col("p_name"), F.lit(True)), rows.select(n.alias("segment_id"), F.col("p_type").alias("translated_text")))
