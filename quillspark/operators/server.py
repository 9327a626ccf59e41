"""Server-side rules of a shared project: manifests, shared keys, activation, dashboards, archives, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.collaboration import server_carry_over


def imported(items: DataFrame, entries: DataFrame) -> DataFrame:
    """The items with the translations of entries (segment_id, original, translation) of the same id and original (line
    ends aside) that are not blank; of several for an id the one of greatest translation; taken ones become manual."""
    same = F.replace(F.col("original_text"), F.lit("\r\n"), F.lit("\n")) == F.col("original")
    own = entries.where(~T.is_blank(F.col("translation"))).groupBy("segment_id", "original").agg(F.max("translation").alias("__new"))
    out = items.join(own, (items.segment_id == own.segment_id) & same, "left").drop(own.segment_id)
    new = F.col("__new").isNotNull()
    return out.withColumn("translated_text", F.coalesce("__new", "translated_text")).withColumn("status", F.when(new, "MANUAL").otherwise(F.col("status"))).select(*items.columns)


def uploaded(items: DataFrame, earlier: DataFrame) -> DataFrame:
    """Work items of a new manifest, with what is carried over from earlier ones: translation, status and state."""
    carried = server_carry_over(items, earlier).select("segment_id", "translation", "tier")
    out = items.join(carried, "segment_id", "left")
    has = F.col("tier").isNotNull()
    return out.withColumn("status", F.when(has, "needs_review").otherwise("pending")).withColumn("carryover_state", F.when(has, "carried").otherwise("new")).drop("tier")


def shared_keys(work_items: DataFrame, known: DataFrame) -> DataFrame:
    """Shared keys (namespace, key, original_text, translation, status, is_new) after an upload: a key that was known
    keeps its translation and takes the new original; the first reference-bearing item of a new key makes it."""
    own = work_items.where("is_reference_bearing_key and coalesce(symbol_namespace, '') != '' and coalesce(original_symbol_key, '') != ''")
    own = own.select(F.col("symbol_namespace").alias("namespace"), F.col("original_symbol_key").alias("key"), "segment_id", "original_text", "translation")
    first = own.groupBy("namespace", "key").agg(F.min_by(F.struct("translation"), "segment_id").alias("a"), F.max_by("original_text", "segment_id").alias("new_text"))
    both = known.select("namespace", "key", F.col("original_text").alias("old_text"), F.col("translation").alias("old"), F.col("status").alias("old_status")).join(first, ["namespace", "key"], "full")
    fresh = F.col("old_status").isNull()
    status = F.when(~fresh, F.col("old_status")).when(F.col("a.translation").isNotNull(), "needs_review").otherwise("pending")
    return both.select("namespace", "key", F.coalesce("new_text", "old_text").alias("original_text"), F.when(fresh, F.col("a.translation")).otherwise(F.col("old")).alias("translation"), status.alias("status"), fresh.alias("is_new"))


def manifest_messages(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, message) of what is wrong with a manifest: an error for each repeat of a key, a warning for each reference
    key without a namespace."""
    w = Window.partitionBy(*keys).orderBy("segment_id")
    repeats = items.withColumn("__n", F.row_number().over(w)).where("__n > 1").select(*keys, F.lit("duplicate key").alias("message"))
    bare = items.where("is_reference_bearing_key and coalesce(symbol_namespace, '') = ''").select(*keys, F.lit("reference key without namespace").alias("message"))
    return repeats.unionByName(bare)


def updated_keys(keys: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (entry_id, base_revision, translation, status) against shared keys (entry_id, revision, translation,
    status): outcome applied, stale or missing, and the state after; each entry has one request at most."""
    own = keys.select("entry_id", "revision", F.col("translation").alias("was"), F.col("status").alias("was_status"))
    out = requests.join(own, "entry_id", "left")
    outcome = F.when(F.col("revision").isNull(), "missing").when(F.col("revision") != F.col("base_revision"), "stale").otherwise("applied")
    out = out.withColumn("outcome", outcome)
    put = F.col("outcome") == "applied"
    return out.select("entry_id", "outcome", F.when(put, F.col("translation")).otherwise(F.col("was")).alias("translation"), F.when(put, F.col("status")).otherwise(F.col("was_status")).alias("status"), (F.col("revision") + put.cast("int")).alias("revision"))


def activated(snapshots: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (snapshot_id, action: activate or delete) against snapshots (snapshot_id, has_manifest, is_active): a
    snapshot without a manifest cannot be activated, an active one cannot be deleted."""
    out = requests.join(snapshots, "snapshot_id", "left")
    outcome = (
        F.when(F.col("has_manifest").isNull(), "missing")
        .when(F.col("action") == "activate", F.when(F.col("has_manifest"), "activated").otherwise("no manifest"))
        .otherwise(F.when(F.col("is_active"), "active").otherwise("deleted"))
    )
    return out.select(*requests.columns, outcome.alias("outcome"))


def dashboard(tables: dict[str, DataFrame], key: str, conflicts: DataFrame) -> DataFrame:
    """(key, kind, n): rows of each table by project, and the conflicts that are open."""
    out = conflicts.where("status = 'open'").groupBy(key).agg(F.count("*").alias("n")).withColumn("kind", F.lit("open_conflicts"))
    for name, rows in tables.items():
        out = out.unionByName(rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("kind", F.lit(name)))
    return out.select(key, "kind", "n")


def member_projects(projects: DataFrame, memberships: DataFrame, user: Column) -> DataFrame:
    """The projects that a user is a member of."""
    return projects.join(memberships.where(user).select("project_id").distinct(), "project_id", "left_semi")


def latest_per_project(rows: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    """The n newest rows of every project: a top-k report."""
    w = Window.partitionBy("project_id").orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def archive_problems(entries: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """(path, files, bytes, problem) of archives from their entries (path, name, size, problem): the first entry problem
    by name, else too many files, too many bytes, or no file."""
    files = ~F.col("name").endswith("/")
    out = entries.groupBy("path").agg(F.count_if(files).alias("files"), F.coalesce(F.sum(F.when(files, F.col("size"))), F.lit(0)).alias("bytes"), F.min(F.when(F.col("problem").isNotNull(), F.struct("name", "problem"))).alias("p"))
    problem = F.coalesce(F.col("p.problem"), F.when(F.col("files") > most_files, "too many files").when(F.col("bytes") > most_bytes, "too many bytes").when(F.col("files") == 0, "no files"))
    return out.select("path", "files", "bytes", problem.alias("problem"))


def unsafe_name(name: Column, forbidden: list[str]) -> Column:
    """Whether a zip entry's name is unsafe: absolute, with a drive, with dots, or in a folder that is left out."""
    own = F.replace(name, F.lit("\\"), F.lit("/"))
    parts = F.split(own, "/")
    outside = own.startswith("/") | F.exists(parts, lambda p: p.isin("..", ".")) | own.rlike("^.:")
    return outside | F.exists(parts, lambda p: F.lower(p).isin([x.lower() for x in forbidden])) if forbidden else outside


def orphans(files: DataFrame, referenced: DataFrame, path: str = "path") -> DataFrame:
    """Files that nothing refers to."""
    return files.join(referenced.select(path).distinct(), path, "left_anti")


def manifest(documents: DataFrame, items: DataFrame, references: DataFrame, identifiers: DataFrame) -> DataFrame:
    """One row a document (document_id, manifest): its JSON of items, references and identifiers, each in order."""

    def part(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("document_id", *order)]
        return rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))

    out = documents
    for name, rows, order in (("items", items, ["line_number", "segment_id"]), ("references", references, ["start"]), ("identifiers", identifiers, ["start"])):
        out = out.join(part(rows, name, order), "document_id", "left")
    return out.select("document_id", F.to_json(F.struct("document_id", "items", "references", "identifiers")).alias("manifest"))
