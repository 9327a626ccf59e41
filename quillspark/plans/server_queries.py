"""Queries of phases, the translation loop, write-back and the server's rules over the standard tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import grouping as G
from quillspark.operators import lexicon as L
from quillspark.operators import phases as H
from quillspark.operators import renames as N
from quillspark.operators import selection as S
from quillspark.operators import server as V
from quillspark.operators import write_back as W
from quillspark.operators.collaboration import outcomes
from quillspark.plans.frames import SEGMENTS, segments, table
from quillspark.plans.generated import WORDS, chosen, chosen_sql, filled, filled_sql
from quillspark.plans.queries import query
from quillspark.plans.shared import dealt

_TYPE = "CASE p_partkey % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'header' ELSE 'script' END"
_KIND = "CASE WHEN p_partkey % 5 = 0 THEN 'identifier-function' ELSE 'print' END"
_PHASE = f"CASE WHEN {_TYPE} = 'csv' AND p_partkey % 2 = 0 THEN 'csv_reference_keys' WHEN {_TYPE} = 'csv' THEN 'csv_general' WHEN p_partkey % 5 = 0 THEN 'identifiers' WHEN {_TYPE} = 'header' THEN 'header' ELSE 'script' END"
TEXTS = ["@w", "@wを見る。", "12", "CFLAG:@w", "@w @w", "%NAME%", "a\n@w", "@w" * 30]


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        n, F.expr(_TYPE).alias("file_type"), F.expr(_KIND).alias("segment_type"), (n % 2 == 0).alias("is_reference_key"), chosen(TEXTS, n).alias("original_text"),
        F.when(n % 7 == 0, "PENDING").when(n % 7 == 1, "FAILED").when(n % 7 == 2, "EXCLUDED").otherwise("DONE").alias("status"),
    )


@query(f"SELECT p_partkey, {_PHASE} AS phase, CASE WHEN {_TYPE} = 'csv' THEN CASE WHEN p_partkey % 2 = 0 THEN 30 ELSE 0 END WHEN p_partkey % 5 = 0 THEN 24 WHEN {_TYPE} = 'header' THEN 16 ELSE 0 END AS mask FROM part")
def item_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [F.col(c) for c in ("file_type", "segment_type", "is_reference_key")]
    return parts(spark, sf_dir).select("p_partkey", H.phase(*own).alias("phase"), H.glossary_mask(*own).alias("mask"))


@query("""SELECT p_partkey, p_partkey % 8 = 0 OR (p_partkey % 2 = 0 AND p_partkey % 8 = 4) AS looked_up,
  p_partkey % 7 > 2 AND p_partkey % 8 IN (0, 1, 4) AS hint FROM part""")
def lookup_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items a dictionary is asked for first, and which may be hints of later phases."""
    rows = parts(spark, sf_dir)
    success = F.col("status") == "DONE"
    return rows.select("p_partkey", H.looked_up_first(F.col("original_text"), F.col("is_reference_key")).alias("looked_up"), H.glossary_source(F.col("original_text"), F.lit("번역"), success).alias("hint"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 2 THEN p_partkey % 4 IN (1, 2) AND p_partkey % 3 > 0 ELSE p_partkey % 4 = 0 AND p_partkey % 3 > 0 END AS writable FROM part""")
def writable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    validation = F.element_at(F.array(*map(F.lit, ["PASS", "AUTO_EXCLUDED", "MANUAL_EXCLUDED", "FAIL"])), (n % 4 + 1).cast("int"))
    rows = parts(spark, sf_dir)
    return rows.select("p_partkey", H.writable(F.col("status"), validation, n % 3 > 0, F.col("original_text"), F.lit("x")).alias("writable"))


@query(f"""SELECT {_PHASE} AS phase, count(*) AS items, count(*) FILTER (p_partkey % 7 = 0) AS pending, count(*) FILTER (p_partkey % 7 > 2) AS done, count(*) FILTER (p_partkey % 7 < 2) AS remaining FROM part GROUP BY 1""")
def phase_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [F.col(c) for c in ("file_type", "segment_type", "is_reference_key")]
    return H.phase_counts(parts(spark, sf_dir).withColumn("phase", H.phase(*own)))


@query(f"""SELECT p_partkey, phase FROM (SELECT p_partkey, {_PHASE} AS phase FROM part) ORDER BY CASE phase WHEN 'csv_reference_keys' THEN 1 WHEN 'csv_general' THEN 2 WHEN 'identifiers' THEN 3 WHEN 'header' THEN 4 ELSE 5 END, p_partkey DESC LIMIT 50""")
def first_in_phase_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty items in display order: a report."""
    own = [F.col(c) for c in ("file_type", "segment_type", "is_reference_key")]
    rows = parts(spark, sf_dir).select("p_partkey", H.phase(*own).alias("phase"))
    return S.in_order(rows, "phase", H.PHASES, F.col("p_partkey").desc()).limit(50)


@query("""WITH x AS (SELECT DISTINCT o_orderpriority, o_custkey % 40 AS f FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY 'f' || CAST(f AS VARCHAR)) AS n FROM x)
  SELECT o.p AS o_orderpriority, o.chars, r.files, r.more FROM (SELECT o_orderpriority AS p, CAST(sum(length(o_orderstatus)) AS BIGINT) AS chars FROM orders GROUP BY 1) o
  JOIN (SELECT o_orderpriority AS p, string_agg('f' || CAST(f AS VARCHAR), ', ' ORDER BY n) FILTER (n <= 2) AS files, count(*) > 2 AS more FROM r GROUP BY 1) r USING (p)""")
def batch_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("path", F.concat(F.lit("f"), (F.col("o_custkey") % 40).cast("string")))
    return H.batch_summary(rows, ["o_orderpriority"], "o_orderstatus", "path")


def _provider(requests: DataFrame) -> DataFrame:
    """A provider for tests: answers in Korean; some only at the second attempt, some damaged, some never."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text, attempt in zip(batch["segment_id"], batch["text"], batch["attempt"], strict=True):
                n = int(i)
                if n % 6 == 1 and not attempt:
                    rows.append((i, None, "timeout"))
                elif n % 6 == 2:
                    rows.append((i, text.replace("__PH0__", "").replace("가", "나"), None))
                elif n % 6 != 3:
                    rows.append((i, "번역" + text.removeprefix("x"), None))
            yield pd.DataFrame(rows, columns=["segment_id", "translated", "error"])

    return requests.select("segment_id", "text", "attempt").mapInPandas(run, "segment_id string, translated string, error string")


def loop_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        n.cast("string").alias("segment_id"), F.concat(F.lit("f"), (n % 10).cast("string")).alias("relative_path"), n.cast("int").alias("line_number"),
        F.concat(F.lit("x"), n.cast("string"), F.lit("%A%")).alias("original_text"), F.lit("").alias("translated_text"), F.lit("script").alias("file_type"), F.lit("print").alias("segment_type"),
        F.when(n % 5 == 0, "MANUAL").otherwise("PENDING").alias("status"),
    )


@query("""SELECT CAST(p_partkey AS VARCHAR) AS segment_id, CASE WHEN p_partkey % 5 = 0 THEN 'MANUAL' WHEN p_partkey % 6 IN (2, 3) THEN 'FAILED' ELSE CASE WHEN (length(CAST(p_partkey AS VARCHAR)) + 5) >= 1.5 * (length(CAST(p_partkey AS VARCHAR)) + 4) THEN 'NEEDS_REVIEW' ELSE 'DONE' END END AS status,
  CASE WHEN p_partkey % 5 = 0 OR p_partkey % 6 IN (2, 3) THEN '' ELSE '번역' || CAST(p_partkey AS VARCHAR) || '%A%' END AS translated_text,
  CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 6 = 2 THEN 'damaged variable' WHEN p_partkey % 6 = 3 THEN 'missing result' END AS reason FROM part""")
def translation_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches, a retry, failures and validation, with a provider for tests."""
    out = H.translated(loop_items(spark, sf_dir), _provider, "en", "ko", batch_size=7, retries=1)
    return out.select("segment_id", "status", "translated_text", "reason")


@query("""SELECT CAST(p_partkey AS VARCHAR) || k AS segment_id, CASE WHEN k = 'a' AND p_partkey % 2 = 0 THEN 'csv_general' WHEN k = 'a' THEN 'header' ELSE 'script' END AS phase, 'DONE' AS status, '번역' || CAST(p_partkey AS VARCHAR) AS translated_text FROM part, (VALUES ('a'), ('b')) t(k)""")
def phase_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases in order: the provider knows only what the first phase of a text asks for; later phases reuse it."""

    def provider(requests: DataFrame) -> DataFrame:
        # items named b have no answer of their own
        own = requests.where(~F.col("segment_id").endswith("b"))
        return own.select("segment_id", F.concat(F.lit("번역"), F.regexp_extract("segment_id", r"\d+", 0)).alias("translated"), F.lit(None).cast("string").alias("error"))

    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("k"))
    name = F.col("p_partkey").cast("string")
    items = rows.select(
        F.concat(name, "k").alias("segment_id"), F.lit("f").alias("relative_path"), F.col("p_partkey").cast("int").alias("line_number"), F.concat(F.lit("원문"), name).alias("original_text"), F.lit("").alias("translated_text"),
        F.lit("script").alias("file_type"), F.lit("print").alias("segment_type"), F.lit("PENDING").alias("status"),
        F.when((F.col("k") == "a") & (F.col("p_partkey") % 2 == 0), "csv_general").when(F.col("k") == "a", "header").otherwise("script").alias("phase"),
    )
    return H.by_phases(items, provider, "en", "ko", retries=0).select("segment_id", "phase", "status", "translated_text")


@query("""SELECT p_partkey AS segment_id, CASE WHEN p_partkey % 4 IN (0, 1) THEN 'neu' || CAST(p_partkey AS VARCHAR) ELSE 'old' END AS translated_text, CASE WHEN p_partkey % 4 IN (0, 1) THEN 'MANUAL' ELSE 'DONE' END AS status FROM part""")
def imported_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations taken in by id where the original is the same; blanks and others are left out."""
    n = F.col("p_partkey")
    rows = table(spark, sf_dir, "part")
    items = rows.select(n.alias("segment_id"), F.concat("p_name", F.lit("\r\n"), "p_brand").alias("original_text"), F.lit("old").alias("translated_text"), F.lit("DONE").alias("status"))
    entries = rows.select(n.alias("segment_id"), F.concat("p_name", F.when(n % 4 == 3, " ").otherwise("\n"), "p_brand").alias("original"), F.when(n % 4 == 2, " ").otherwise(F.concat(F.lit("neu"), n.cast("string"))).alias("translation"))
    return V.imported(items, entries).select("segment_id", "translated_text", "status")


@query(f"""WITH {SEGMENTS}, i AS (SELECT *, doc_id % 4 = 1 AS bearing FROM segments),
  t AS (SELECT original_text, max(segment_id) AS m FROM i WHERE doc_id % 2 = 0 GROUP BY 1)
  SELECT i.segment_id, CASE WHEN t.m IS NULL THEN 'pending' ELSE 'needs_review' END AS status, CASE WHEN t.m IS NULL THEN 'new' ELSE 'carried' END AS carryover_state, t.m AS translation FROM i LEFT JOIN t USING (original_text)""")
def uploaded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir)
    earlier = rows.where("doc_id % 2 = 0").select(F.concat(F.lit("e"), "segment_id").alias("segment_id"), F.lit(None).cast("string").alias("source_key"), "original_text", F.col("segment_id").alias("translation"), F.lit(1).alias("updated"))
    return V.uploaded(rows.select("segment_id", "source_key", "original_text"), earlier).select("segment_id", "status", "carryover_state", "translation")


@query("""WITH w AS (SELECT p_partkey AS sid, p_brand AS ns, p_type AS k, p_name AS t, CASE WHEN p_partkey % 2 = 0 THEN 'tr' || CAST(p_partkey AS VARCHAR) END AS tr FROM part WHERE p_partkey % 3 > 0),
  f AS (SELECT ns, k, arg_min(struct_pack(x := tr), sid).x AS tr, arg_max(t, sid) AS t FROM w GROUP BY ALL),
  o AS (SELECT DISTINCT p_brand AS ns, p_type AS k FROM part WHERE p_size < 10)
  SELECT coalesce(f.ns, o.ns) AS namespace, coalesce(f.k, o.k) AS key, coalesce(f.t, 'old text') AS original_text, CASE WHEN o.ns IS NOT NULL THEN 'old' ELSE f.tr END AS translation,
    CASE WHEN o.ns IS NOT NULL THEN 'approved' WHEN f.tr IS NOT NULL THEN 'needs_review' ELSE 'pending' END AS status, o.ns IS NULL AS is_new FROM f FULL JOIN o ON f.ns = o.ns AND f.k = o.k""")
def shared_key_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    work = rows.select(n.alias("segment_id"), (n % 3 > 0).alias("is_reference_bearing_key"), F.col("p_brand").alias("symbol_namespace"), F.col("p_type").alias("original_symbol_key"), F.col("p_name").alias("original_text"), F.when(n % 2 == 0, F.concat(F.lit("tr"), n.cast("string"))).alias("translation"))
    known = rows.where("p_size < 10").select(F.col("p_brand").alias("namespace"), F.col("p_type").alias("key")).distinct().select("*", F.lit("old text").alias("original_text"), F.lit("old").alias("translation"), F.lit("approved").alias("status"))
    return V.shared_keys(work, known)


@query("""SELECT p_brand, p_size, 'duplicate key' AS message FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS n FROM part) WHERE n > 1
  UNION ALL SELECT p_brand, p_size, 'reference key without namespace' FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 8 = 0""")
def manifest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    items = table(spark, sf_dir, "part").select("p_brand", "p_size", n.alias("segment_id"), (n % 4 == 0).alias("is_reference_bearing_key"), F.when(n % 8 != 0, "ns").alias("symbol_namespace"))
    return V.manifest_messages(items, ["p_brand", "p_size"])


@query("""SELECT c_custkey AS entry_id, CASE WHEN c_custkey % 7 = 0 THEN 'missing' WHEN c_custkey % 3 = 0 THEN 'stale' ELSE 'applied' END AS outcome,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS translation, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'a' ELSE 'b' END AS status,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 5 ELSE 6 END AS revision FROM customer""")
def updated_shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = table(spark, sf_dir, "customer"), F.col("c_custkey")
    keys = rows.where(n % 7 != 0).select(n.alias("entry_id"), F.lit(5).alias("revision"), F.col("c_name").alias("translation"), F.lit("a").alias("status"))
    return V.updated_keys(keys, rows.select(n.alias("entry_id"), F.when(n % 3 == 0, 4).otherwise(5).alias("base_revision"), F.col("c_mktsegment").alias("translation"), F.lit("b").alias("status")))


@query("""SELECT s_suppkey AS snapshot_id, a AS action, CASE WHEN s_suppkey % 5 = 0 THEN 'missing' WHEN a = 'activate' THEN CASE WHEN s_suppkey % 2 = 0 THEN 'activated' ELSE 'no manifest' END ELSE CASE WHEN s_suppkey % 3 = 0 THEN 'active' ELSE 'deleted' END END AS outcome
  FROM supplier, (VALUES ('activate'), ('delete')) t(a)""")
def snapshot_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    snapshots = rows.where(n % 5 != 0).select(n.alias("snapshot_id"), (n % 2 == 0).alias("has_manifest"), (n % 3 == 0).alias("is_active"))
    return V.activated(snapshots, rows.select(n.alias("snapshot_id"), F.explode(F.array(F.lit("activate"), F.lit("delete"))).alias("action")))


@query("""SELECT s_nationkey AS project_id, 'open_conflicts' AS kind, count(*) AS n FROM supplier WHERE s_acctbal < 0 GROUP BY 1 UNION ALL SELECT c_nationkey, 'memberships', count(*) FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'submissions', count(*) FROM supplier GROUP BY 1""")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("project_id", F.col("s_nationkey")).withColumn("status", F.when(F.col("s_acctbal") < 0, "open").otherwise("closed"))
    c = table(spark, sf_dir, "customer").withColumn("project_id", F.col("c_nationkey"))
    return V.dashboard({"memberships": c, "submissions": s}, "project_id", s)


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)""")
def member_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = table(spark, sf_dir, "supplier").withColumn("project_id", F.col("s_nationkey"))
    return V.member_projects(projects, table(spark, sf_dir, "customer").withColumn("project_id", F.col("c_nationkey")), (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 5000)).select("s_suppkey", "s_name")


@query("""SELECT o_custkey AS project_id, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 10""")
def latest_per_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("project_id", F.col("o_custkey"))
    return V.latest_per_project(rows, [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("project_id", "o_orderkey")


@query("""WITH e AS (SELECT l_orderkey AS path, 'd' || CAST(l_linenumber AS VARCHAR) || CASE WHEN l_linenumber = 7 THEN '/' ELSE '' END AS name, CAST(l_quantity AS BIGINT) AS size, CASE WHEN l_suppkey % 50 = 0 THEN 'unsafe' END AS p FROM lineitem)
  SELECT path, count(*) FILTER (name NOT LIKE '%/') AS files, CAST(coalesce(sum(size) FILTER (name NOT LIKE '%/'), 0) AS BIGINT) AS bytes,
    CASE WHEN count(p) > 0 THEN 'unsafe' WHEN count(*) FILTER (name NOT LIKE '%/') > 5 THEN 'too many files' WHEN sum(size) FILTER (name NOT LIKE '%/') > 100 THEN 'too many bytes' WHEN count(*) FILTER (name NOT LIKE '%/') = 0 THEN 'no files' END AS problem FROM e GROUP BY 1""")
def archive_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    entries = rows.select(F.col("l_orderkey").alias("path"), F.concat(F.lit("d"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") == 7, "/").otherwise("")).alias("name"), F.col("l_quantity").cast("long").alias("size"), F.when(F.col("l_suppkey") % 50 == 0, "unsafe").alias("problem"))
    return V.archive_problems(entries, 5, 100)


NAMES = ["a/@n.erb", "/a", "a/../b", "C:\\x", "a\\b", "a/.git/@n", "../x", "a//b"]


@query(f"SELECT p_partkey, {chosen_sql(['false', 'true', 'true', 'true', 'false', 'true', 'true', 'false'], 'p_partkey')} = 'true' AS unsafe FROM part")
def unsafe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", chosen(NAMES, F.col("p_partkey")).alias("name"))
    return rows.select("p_partkey", V.unsafe_name(F.col("name"), [".git"]).alias("unsafe"))


@query("SELECT o_custkey AS path FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"))
    return V.orphans(files, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("path")))


@query("""SELECT s.l_orderkey AS target_id, s.l_linenumber, CASE WHEN o.o_orderkey IS NULL THEN 'Rejected' WHEN s.c IS NOT NULL THEN 'Conflict' WHEN s.o_orderstatus = s.l_linestatus THEN 'NoOp' ELSE 'Applied' END AS result, s.c AS conflict
  FROM (SELECT l.*, o.o_orderstatus, CASE WHEN o.o_orderkey IS NULL THEN NULL WHEN o.o_orderkey % 2 = 0 THEN 'ProjectScopeConflict' WHEN l.l_suppkey % 5 = 0 THEN 'SourceChangedConflict' WHEN o.o_orderstatus <> l.l_linestatus AND o.o_orderkey % 4 <> l.l_linenumber % 4 THEN 'SharedNamespaceConflict' END AS c
    FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l.l_orderkey = o.o_orderkey) s LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o ON o.o_orderkey = s.l_orderkey""")
def shared_key_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted shared keys: no assignment is checked, and stale ones have a conflict of their own."""
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("target_id"), "l_linenumber", F.lit(0).alias("project_id"), F.lit(1).alias("revision_id"), F.when(F.col("l_suppkey") % 5 == 0, 2).otherwise(1).alias("current_revision_id"), (F.col("l_linenumber") % 4).cast("long").alias("base_revision"), F.col("l_linestatus").alias("translation"), F.lit(False).alias("may_edit"))
    targets = table(spark, sf_dir, "orders").where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("target_id"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(0).alias("t_project_id"), F.lit(9).alias("t_revision_id"), (F.col("o_orderkey") % 4).alias("t_revision"), F.col("o_orderstatus").alias("t_translation"))
    return outcomes(changes, targets, "SharedNamespaceConflict", checks_assignment=False).select("target_id", "l_linenumber", "result", "conflict")


DOC = "X = ITEM:@w + 함수(@n) PRINT 글@n를"
_DOC, _P = filled_sql(DOC, "p_partkey"), "p_partkey"


@query(f"""SELECT CAST(p_partkey AS VARCHAR) AS document_id, CASE WHEN p_partkey % 2 = 0 THEN {filled_sql("X = ITEM:새 + FN(@n) PRINT 문장", _P)} ELSE {filled_sql("X = ITEM:새 + FN(@n) PRINT 글@n을", _P)} END AS text, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 3 END AS edits FROM part""")
def written_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of four sources: a segment inside a planned edit gives way, particles give way to segments."""
    n = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(n, n.cast("string").alias("document_id"), filled(DOC, n).alias("text"))

    def edit(what: str, value: str, where=None) -> DataFrame:
        own = rows if where is None else rows.where(where)
        return own.select("document_id", (F.instr("text", filled(what, n)) - 1).alias("start"), F.length(filled(what, n)).alias("length"), filled(value, n).alias("value"))

    segments_ = edit("글@n를", "문장", n % 2 == 0).union(edit("@w", "내부"))
    edits = W.chosen_edits(segments_, edit("ITEM:@w", "ITEM:새"), edit("글@n를", "글@n을"), edit("함수", "FN"))
    return W.written(rows.select("document_id", "text"), edits.drop("source"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 5 = 0 THEN 'skipped' WHEN p_partkey % 3 = 0 THEN 'written' ELSE 'copied' END AS outcome FROM part""")
def export_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(n, n.cast("string").alias("document_id"))
    files = rows.select(F.col("document_id").alias("path"), F.lit(True).alias("is_source"))
    return W.export_list(files, rows.where(n % 5 != 0), rows.where(n % 3 == 0))


INSIDE = ["X = F(a, ", "%A ", '"%" ', "{x", "{x} ", "(a", "F(x) ", "text @n", 'F("(" ', "a\n%"]
INSIDE_IS = ["true", "true", "false", "true", "false", "false", "false", "false", "true", "true"]


@query(f"SELECT p_partkey, {chosen_sql(INSIDE_IS, 'p_partkey')} = 'true' AS inside FROM part")
def expression_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", chosen(INSIDE, F.col("p_partkey")).alias("t"))
    return rows.select("p_partkey", W.inside_expression(F.concat("t", F.lit("여기\n%")), F.length("t")).alias("inside"))


@query("""SELECT l_orderkey AS document_id, l_linenumber * 10 AS start, length(p_type) AS length, 'new ' || p_name AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 20""")
def identifier_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    uses = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") * 10).alias("start"), F.length("p_type").alias("length"), F.col("p_brand").alias("kind"), F.col("p_partkey").alias("name"))
    return N.identifier_edits(uses, part.where("p_size < 20").select(F.col("p_brand").alias("kind"), F.col("p_partkey").alias("name"), F.concat(F.lit("new "), "p_name").alias("new_name")))


_TEXT = filled_sql("古い@wと@wの話", "p_partkey")


@query(f"""SELECT p_partkey, CAST(i - 1 AS INTEGER) AS start, t.term FROM part, (VALUES {", ".join(f"('{w}')" for w in [*WORDS, "話", "い薬"])}) t(term), unnest(generate_series(1, length({_TEXT}))) s(i) WHERE substr({_TEXT}, i, length(t.term)) = t.term""")
def contained_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms anywhere in texts without blanks, by character n-grams."""
    texts = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", filled("古い@wと@wの話", F.col("p_partkey")).alias("text"))
    terms = spark.createDataFrame([(w,) for w in [*WORDS, "話", "い薬"]], "term string")
    return L.contained_terms(texts, "p_partkey", "text", terms, "term", 2).select("p_partkey", "start", "term")


@query("""SELECT p_partkey AS "group", s.source FROM part, (VALUES ('abc'), ('de'), ('d')) s(source) WHERE s.source = 'abc' OR (s.source = 'de' AND p_partkey % 2 = 0) OR (s.source = 'd' AND p_partkey % 2 = 1)""")
def hint_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints that have a free range, in order of priority, length and score; a hint taken occupies all its ranges."""
    n = F.col("p_partkey")
    span = "array<struct<text_id:int,start:int,end:int>>"
    rows = table(spark, sf_dir, "part").select(n.alias("group"), F.explode(F.array(
        F.struct(F.lit("abc").alias("source"), F.lit(2).alias("priority"), F.lit(1).alias("score"), F.expr(f"CAST(array(struct(1, 0, 3)) AS {span})").alias("ranges")),
        F.struct(F.lit("bc").alias("source"), F.lit(1).alias("priority"), F.lit(9).alias("score"), F.expr(f"CAST(array(struct(1, 1, 3)) AS {span})").alias("ranges")),
        F.struct(F.lit("de").alias("source"), F.lit(1).alias("priority"), F.lit(1).alias("score"), F.when(n % 2 == 0, F.expr(f"CAST(array(struct(1, 5, 7)) AS {span})")).otherwise(F.expr(f"CAST(array(struct(1, 2, 4)) AS {span})")).alias("ranges")),
        F.struct(F.lit("d").alias("source"), F.lit(1).alias("priority"), F.lit(0).alias("score"), F.expr(f"CAST(array(struct(1, 5, 6)) AS {span})").alias("ranges")),
    )).alias("x")).select("group", "x.*")
    return L.free_range_choice(rows, "group")


@query("""SELECT k, CASE WHEN k % 3 = 0 THEN 'user' WHEN k % 2 = 0 THEN 'reference' ELSE 'bundled' END AS layer FROM (SELECT c_custkey AS k FROM customer)""")
def merged_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints of several providers by precedence: bundled, then references, then the user's own."""
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    layers = [k.withColumn("layer", F.lit("bundled")), k.where("k % 2 = 0").withColumn("layer", F.lit("reference")), k.where("k % 3 = 0").withColumn("layer", F.lit("user"))]
    return G.by_precedence(layers, ["k"])


@query("""WITH t AS (SELECT p_brand || ' ' || p_name || ' ' || CAST(p_size % 9 AS VARCHAR) AS term, p_type FROM part)
  SELECT term, p_type FROM (SELECT term, min(p_type) AS p_type FROM t GROUP BY 1 HAVING count(DISTINCT p_type) = 1) ORDER BY length(term) DESC, term LIMIT 40""")
def longest_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty longest terms that have one target: a report."""
    term = F.concat_ws(" ", "p_brand", "p_name", (F.col("p_size") % 9).cast("string"))
    return L.one_target_terms(table(spark, sf_dir, "part").select(term.alias("term"), "p_type"), "term", "p_type").limit(40)


