"""Queries of sources and sinks: encodings, CSV, exchange files, dictionaries, lexicons, sessions, archives, versions."""

from __future__ import annotations

import io
import sqlite3
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import lexicon as L
from quillspark.operators import server as V
from quillspark.operators import sync as Y
from quillspark.plans.frames import table
from quillspark.plans.generated import chosen, chosen_sql, filled, filled_sql, places_sql, quoted, scripts
from quillspark.plans.queries import query
from quillspark.plans.shared import shared_path
from quillspark.sources import exchange as E
from quillspark.sources import project as P
from quillspark.sources import script, tables
from quillspark.streaming.progress import VersionedTable

N = "p_partkey"
PROSE = "薬草の記録。\r\nつぎの行です\r\n"
CODED = [("utf-8", PROSE.encode()), ("utf-8-sig", b"\xef\xbb\xbf" + PROSE.encode()), ("utf-16-le", b"\xff\xfe" + PROSE.encode("utf-16-le")), ("cp932", PROSE.encode("cp932")), ("euc_jp", PROSE.encode("euc_jp"))]


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col(N)
    content = F.element_at(F.array(*(F.unhex(F.lit(c.hex())) for _, c in CODED)), (n % len(CODED) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(n.cast("string").alias("document_id"), F.lit("script").alias("file_type"), content.alias("content"))


@query(f"""SELECT CAST({N} AS VARCHAR) AS document_id, {quoted(PROSE)} AS text, ['utf-8', 'utf-8-sig', 'utf-16-le', 'cp932', 'euc_jp'][{N} % 5 + 1] AS encoding, chr(13) || chr(10) AS newline FROM part""")
def decoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.documents(coded(spark, sf_dir)).select("document_id", "text", "encoding", "newline")


@query(f"""SELECT CAST({N} AS VARCHAR) AS document_id, ['{"', '".join(c.hex().upper() for _, c in CODED)}'][{N} % 5 + 1] AS back, CASE WHEN {N} % 5 > 2 THEN '{CODED[1][1].hex().upper()}' END AS utf8 FROM part""")
def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents back in their encoding, and legacy ones as UTF-8 with a mark."""
    docs = P.documents(coded(spark, sf_dir))
    back = docs.select("document_id", F.hex(P.encoded("text", "encoding")).alias("back"))
    return back.join(E.as_utf8(docs).select("document_id", F.hex("content").alias("utf8")), "document_id", "left")


@query(f"SELECT {N}, p_name FROM part")
def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files written and read again: tables under CSV count, what lies elsewhere or has another name does not."""
    root = shared_path(spark, f"project-{uuid.uuid4().hex}")
    rows = table(spark, sf_dir, "part").select(N, "p_name")
    rows.write.csv(f"{root}/CSV")
    rows.limit(5).write.csv(f"{root}/other")
    rows.limit(5).write.json(f"{root}/ERB")
    docs = P.documents(P.files(spark, root)).where("file_type = 'csv'")
    fields = docs.select(F.explode(F.split("text", "\n")).alias("line")).where("line != ''").select(P.csv_fields(F.col("line")).alias("f"))
    return fields.select(F.get("f", F.lit(0))["value"].cast("long").alias(N), F.get("f", F.lit(1))["value"].alias("p_name"))


CSV = ["@n,@w", ' 1 , "a,""@w""" ,', ";x", '"open,@w']
CELLS = {0: [("0", "@n", "@n"), ("1", "@w", "@w")], 1: [("0", " 1 ", "1"), ("1", ' "a,""@w""" ', 'a,"@w"'), ("2", "", "")], 2: [("0", ";x", ";x")], 3: [("0", '"open,@w', '"open,@w')]}


@query(" UNION ALL ".join(f"SELECT {N}, {i} AS field_index, {filled_sql(raw, N)} AS raw, {filled_sql(v, N)} AS value FROM part WHERE {N} % 4 = {k}" for k, cells in CELLS.items() for i, raw, v in cells))
def csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(N, F.explode(P.csv_fields(chosen(CSV, F.col(N)))).alias("f"))
    return rows.select(N, "f.field_index", "f.raw", "f.value")


@query(f"SELECT {N}, {chosen_sql(['@n,新', ' 1 , \"新\" ,', ';x', '\"open,@w'], N)} AS line FROM part")
def rebuilt_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their second field replaced, blanks and quotes kept; the quoted field stays quoted."""
    line = P.rebuilt(P.csv_fields(chosen(CSV, F.col(N))), F.create_map(F.lit(1), F.lit("新")))
    return table(spark, sf_dir, "part").select(N, line.alias("line"))


KINDS = ["CSV/VariableSize.csv", "CSV/CHARA@n.csv", "CSV/a.csv", "CSV/b.csv", "CSV/c.csv", "CSV/d.csv"]
FIRST = ["A,1", "x", "番号,1", "3,x", "k,v", "k,v,w"]


@query(f"SELECT {N}, {chosen_sql(['Generic', 'CharacterSheet', 'CharacterSheet', 'IdFirst', 'KeyValue', 'Generic'], N)} AS kind FROM part")
def csv_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col(N)
    fields = F.transform(P.csv_fields(chosen(FIRST, n)), lambda f: f["value"])
    return table(spark, sf_dir, "part").select(N, P.csv_kind(chosen(KINDS, n), fields).alias("kind"))


ITEMS = [";注釈", "0,@w", '1, "青い@w"', "2,12", "3,"]


def _cell(index: int, line: int) -> dict[str, str]:
    return {"segment_index": str(index), "field_index": "1", "text": "@value", "kind": "'IdFirst'", "namespace": "'ITEM'", "symbol_key": "@value"}


_CELLS = places_sql(ITEMS, N, "part", [(1, "0,", "@w", _cell(0, 1)), (2, '1, "', "青い@w", _cell(1, 2))])


@query(f"SELECT document_id || '/Item.csv' AS document_id, line_number + 1 AS line_number, start, length, segment_index, field_index, text, kind, namespace, symbol_key FROM ({_CELLS})")
def csv_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scripts(table(spark, sf_dir, "part"), N, ITEMS).withColumn("document_id", F.concat("document_id", F.lit("/Item.csv")))
    out = tables.csv_segments(docs)
    return out.select("document_id", "line_number", F.col("start").cast("int").alias("start"), "length", F.col("segment_index").cast("int").alias("segment_index"), "field_index", "text", "kind", "namespace", "symbol_key")


LINES = ["X = {", ";注釈", "@w", "}", "PRINTL @n", ";#;CALL @w"]


@query(f"""SELECT CAST({N} AS VARCHAR) AS document_id, k AS line_number, CASE k WHEN 0 THEN {filled_sql("X = {", N)} || chr(10) || '   ' || chr(10) || {filled_sql("@w", N)} || chr(10) || '}}' WHEN 4 THEN {filled_sql("PRINTL @n", N)} ELSE {filled_sql("   CALL @w", N)} END AS code,
  CAST(CASE k WHEN 0 THEN 0 WHEN 4 THEN 6 + 4 + 3 + 2 ELSE 6 + 4 + 3 + 2 + length({filled_sql("PRINTL @n", N)}) + 1 END AS INTEGER) AS start FROM part, (VALUES (0), (4), (5)) t(k)""")
def logical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script.logical_lines(scripts(table(spark, sf_dir, "part"), N, LINES))


@query(f"SELECT DISTINCT namespace FROM (SELECT upper('Stem' || CAST({N} % 50 AS VARCHAR)) AS namespace FROM part WHERE {N} % 3 > 0 UNION ALL SELECT 'ABL')")
def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col(N)
    name = F.concat(F.lit("CSV/"), F.when(n % 3 == 0, "_").otherwise(""), F.lit("Stem"), (n % 50).cast("string"), F.when(n % 2 == 0, "@2").otherwise(""), F.lit(".csv"))
    return script.namespaces(table(spark, sf_dir, "part").select(name.alias("document_id"), F.lit("csv").alias("file_type")), ["ABL"])


@query(f"SELECT CAST({N} AS VARCHAR) AS id, p_name || chr(10) || 'x' AS original, CASE WHEN {N} % 2 = 0 THEN p_type ELSE '' END AS translation FROM part")
def exchange_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written as text and read again."""
    n = F.col(N)
    rows = table(spark, sf_dir, "part").select(n.cast("string").alias("id"), F.concat("p_name", F.lit("\nx")).alias("original"), F.when(n % 2 == 0, F.col("p_type")).otherwise("").alias("translation"))
    return P.read_exchange(P.write_exchange(rows).select(F.concat("value", F.lit("\n")).alias("text")))


PAIRED = ["; head", '"@w"', '"대상@n"', "", '"홀로"', "", "plain", '"a"', '"b"']


@query(f"SELECT CAST({N} AS VARCHAR) AS document_id, s AS source, t AS target FROM (SELECT {N}, {filled_sql('@w', N)} AS s, {filled_sql('대상@n', N)} AS t FROM part UNION ALL SELECT {N}, 'a', 'b' FROM part)")
def paired_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scripts(table(spark, sf_dir, "part"), N, PAIRED)
    lines = docs.select("document_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return E.paired_lines(lines, "document_id", "n", "line")


@query(f"SELECT p_name || chr(9) || '{chr(92)}' AS source, p_type AS target, CASE WHEN {N} % 2 = 0 THEN 'replace' ELSE 'prompting' END AS mode, {N} % 3 > 0 AS is_enabled, FALSE AS skipped FROM part UNION ALL SELECT 'bad', NULL, NULL, NULL, TRUE")
def dictionary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's dictionary exported as tab-separated lines and imported again; a line that does not fit is skipped."""
    n = F.col(N)
    entries = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit("\t\\")).alias("source"), F.col("p_type").alias("target"), F.when(n % 2 == 0, "replace").otherwise("prompting").alias("mode"), (n % 3 > 0).alias("is_enabled"))
    modes, enabled = {"replace": "R", "prompting": "P"}, {True: "on", False: "off"}
    lines = E.dictionary_lines(entries, modes, enabled).union(spark.createDataFrame([("# head",), ("bad",), ("",)], "value string"))
    return L.import_dictionary(lines, "value", {v: k for k, v in modes.items()}, {v: k for k, v in enabled.items()}, "#")


XML = "<entry><k_ele><keb>@w</keb><ke_pri>news1</ke_pri></k_ele><k_ele><keb>別@n</keb></k_ele><r_ele><reb>よみ@n</reb><re_pri>nf02</re_pri></r_ele><sense><pos>n</pos><pos>vs</pos></sense></entry>"


@query(f"""SELECT s AS surface, {filled_sql("よみ@n", N)} AS reading, 500 AS priority, 'n|vs' AS kinds, FALSE AS is_name, 'lexicon' AS source, CASE WHEN s LIKE '別%' AND {N} % 2 = 0 THEN 'high' END AS target
  FROM part, LATERAL (SELECT unnest([{filled_sql("@w", N)}, {filled_sql("別@n", N)}]) AS s)""")
def lexicon_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in XML as terms, with the override of greatest priority for a surface."""
    n = F.col(N)
    rows = table(spark, sf_dir, "part")
    terms = E.lexicon_terms(E.xml_entries(rows.select(filled(XML, n).alias("xml")), "xml"), False, "lexicon")
    overrides = rows.where(n % 2 == 0).select(filled("別@n", n).alias("surface"), F.explode(F.array(F.struct(F.lit(1).alias("priority"), F.lit("low").alias("target")), F.struct(F.lit(2).alias("priority"), F.lit("high").alias("target")))).alias("o")).select("surface", "o.*")
    return E.overridden(terms, overrides, "surface").select("surface", "reading", "priority", "kinds", "is_name", "source", "target")


def _database() -> bytes:
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE progress (segment_id TEXT, status TEXT, can_save INTEGER)")
    db.executemany("INSERT INTO progress VALUES (?, ?, ?)", [("a:1", "DONE", 1), ("a:2", "완료", 0), ("a:3", None, 1)])
    db.commit()
    return db.serialize()


@query(f"SELECT CAST({N} AS VARCHAR) AS path, s AS segment_id, v AS status, c AS can_save FROM part, (VALUES ('a:1', 'DONE', 1), ('a:2', '완료', 0), ('a:3', NULL, 1)) t(s, v, c)")
def sqlite_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.col(N).cast("string").alias("path"), F.lit(_database()).alias("content"))
    return E.sqlite_rows(files, "progress", "segment_id string, status string, can_save int")


@query(f"SELECT {N}, 'd' || CAST(k AS VARCHAR) AS document_id, 's' || CAST({N} * k AS VARCHAR) AS segment_id, p_name AS translated_text FROM part, (VALUES (1), (2)) t(k)")
def json_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def document(k: int):
        item = F.struct(F.concat(F.lit("s"), (F.col(N) * k).cast("string")).alias("segment_id"), F.col("p_name").alias("translated_text"))
        return F.struct(F.lit(f"d{k}").alias("document_id"), F.array(item).alias("items"))

    texts = table(spark, sf_dir, "part").select(N, F.to_json(F.struct(F.array(document(1), document(2)).alias("documents"))).alias("json"))
    return E.session_items(texts, "json", "struct<segment_id:string,translated_text:string>")


@query(f"SELECT p_brand AS project, TRUE AS has_script, count(*) FILTER ({N} % 3 = 0) > 0 AS has_header, count(*) FILTER ({N} % 3 = 1 AND {N} % 2 = 0) > 0 AS has_0, FALSE AS has_1, count(*) FILTER ({N} % 3 = 2) > 0 AS linked FROM part GROUP BY 1 HAVING count(*) FILTER ({N} % 3 = 1) > 0 UNION ALL SELECT p_brand, FALSE, count(*) FILTER ({N} % 3 = 0) > 0, FALSE, FALSE, count(*) FILTER ({N} % 3 = 2) > 0 FROM part GROUP BY 1 HAVING count(*) FILTER ({N} % 3 = 1) = 0")
def support_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col(N)
    name = F.when(n % 3 == 0, "ERB/zname.erh").when(n % 3 == 1, "ERB/ZNAME.ERB").otherwise("ERB/x.erb")
    text = F.when(n % 3 == 2, "x\n#include ZNAME").when(n % 2 == 0, "@조사처리").otherwise("x")
    return E.support_package(table(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), name.alias("document_id"), text.alias("text")))


def _archive() -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ("ERB/a.erb", "../up", "/abs", "erb/A.ERB"):
            z.writestr(zipfile.ZipInfo(name), "x" * 10)
    return data.getvalue()


@query(f"SELECT CAST({N} AS VARCHAR) AS path, n AS name, 10 AS size, p AS problem FROM part, (VALUES ('ERB/a.erb', NULL), ('../up', 'unsafe'), ('/abs', 'unsafe'), ('erb/A.ERB', 'duplicate')) t(n, p)")
def zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.zip_entries(table(spark, sf_dir, "part").select(F.col(N).cast("string").alias("path"), F.lit(_archive()).alias("content")))


@query(f"""SELECT CAST({N} AS VARCHAR) AS document_id, '{{"document_id":"' || CAST({N} AS VARCHAR) || '","items":[{{"line_number":1,"segment_id":"a"}},{{"line_number":2,"segment_id":"b"}}],"references":[{{"start":5,"namespace":"ABL"}}]' || CASE WHEN {N} % 2 = 0 THEN ',"identifiers":[{{"start":1,"name":"x"}}]' ELSE '' END || '}}' AS manifest FROM part""")
def scan_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "part").select(N, F.col(N).cast("string").alias("document_id"))
    items = docs.select("document_id", F.explode(F.array(F.struct(F.lit(2).alias("line_number"), F.lit("b").alias("segment_id")), F.struct(F.lit(1).alias("line_number"), F.lit("a").alias("segment_id")))).alias("x")).select("document_id", "x.*")
    references = docs.select("document_id", F.lit(5).alias("start"), F.lit("ABL").alias("namespace"))
    return V.manifest(docs.select("document_id"), items, references, docs.where(F.col(N) % 2 == 0).select("document_id", F.lit(1).alias("start"), F.lit("x").alias("name")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 5 <> 0""")
def versioned_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A progress table written, upserted, and rows deleted, each as a version; old versions are removed."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(0).alias("at"))
    store = VersionedTable(spark, shared_path(spark, f"progress-{uuid.uuid4().hex}"))
    store.delete(orders.select("o_orderkey"))
    store.snapshot(orders, ["o_orderkey"])
    store.upsert(orders.where("o_orderkey % 3 = 0").withColumn("status", F.lit("new")).withColumn("at", F.lit(1)), ["o_orderkey"], "at")
    store.delete(orders.where("o_orderkey % 5 = 0").select("o_orderkey"))
    store.vacuum(1)
    return store.read().select("o_orderkey", "status")


@query("""SELECT c_custkey, CASE WHEN second_ok AND shared IS NOT NULL THEN shared ELSE first END AS translation FROM (
  SELECT *, submitted = '' OR first = submitted AS second_ok FROM (
    SELECT c_custkey, submitted, shared, CASE WHEN server IS NOT NULL AND (submitted = '' OR translation = submitted) THEN server ELSE translation END AS first FROM (
      SELECT c_custkey, c_name AS translation, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN '' ELSE 'x' END AS submitted, s_name AS server, CASE WHEN n_name IS NOT NULL THEN 'shared ' || n_name END AS shared
      FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey)))""")
def server_states_with_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items and then shared keys of the server put in where nothing was changed since the last submission."""
    n = F.col("c_custkey") % 3
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("segment_id"), F.lit("nation").alias("namespace"), F.col("c_nationkey").alias("key"), F.col("c_name").alias("translation"), F.when(n == 0, F.col("c_name")).when(n == 1, "").otherwise("x").alias("submitted"))
    work = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("segment_id"), F.col("s_name").alias("server"))
    shared = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.lit("nation").alias("namespace"), F.col("n_nationkey").alias("key"), F.concat(F.lit("shared "), "n_name").alias("shared"))
    return Y.applied(items, work, shared).select(F.col("segment_id").alias("c_custkey"), "translation")
