"""Operators on items: restoring saved states, correcting equal originals, looking terms up, indirect renames, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions import text as T
from quillspark.operators.lexicon import best_entry
from quillspark.operators.selection import replaced

DONE = ["DONE", "NEEDS_REVIEW", "MANUAL"]


def restored_state(status: Column, validation: Column, can_save: Column, translated: Column) -> Column:
    """(status, validation, can_save, translated_text) of a saved state as it is taken up again: what was under way has
    stopped, what had failed validation is for review, and a finished item without a text has failed."""
    own = F.when(status.isin("TRANSLATING", "RETRYING"), "STOPPED").when(status == "VALIDATION_FAILED", "NEEDS_REVIEW").when(status == "WAITING", "PENDING").otherwise(status)
    empty = own.isin(DONE) & T.is_blank(translated)
    valid = F.when(own == "STOPPED", "UNCHECKED").when(F.coalesce(F.trim(validation), F.lit("")) == "", "UNCHECKED").otherwise(validation)
    saves = F.when(own == "STOPPED", False).when(own == "EXCLUDED", True).otherwise(can_save)
    return F.struct(
        F.when(empty, "FAILED").otherwise(own).alias("status"),
        F.when(empty, "BLANK").otherwise(valid).alias("validation"),
        F.when(empty, False).otherwise(saves).alias("can_save"),
        F.when(empty, "").otherwise(translated).alias("translated_text"),
    )


def restored(items: DataFrame, progress: DataFrame) -> DataFrame:
    """The items (segment_id, ...) with their saved states by id; items without one wait."""
    state = restored_state(F.col("status"), F.col("validation"), F.col("can_save"), F.col("translated_text"))
    saved = progress.select("segment_id", state.alias("s"))
    wait = F.struct(F.lit("PENDING").alias("status"), F.lit("UNCHECKED").alias("validation"), F.lit(False).alias("can_save"), F.lit("").alias("translated_text"))
    return items.join(saved, "segment_id", "left").withColumn("s", F.coalesce("s", wait)).select(*items.columns, "s.*")


def corrected(items: DataFrame, source_priority: Column, status_priority: Column) -> DataFrame:
    """The items (segment_id, original_text, translated_text, status, relative_path, line_number) with one translation
    for equal originals: that of first source priority, status priority, path, line and id; excluded items stay.

    The choice is one aggregate a text; a priority of null is no source."""
    text = F.regexp_replace(F.replace(F.replace(F.col("original_text"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    own = items.withColumn("__t", text)
    usable = source_priority.isNotNull() & ~T.is_blank(F.col("translated_text"))
    order = F.struct(source_priority.alias("a"), status_priority.alias("b"), "relative_path", "line_number", "segment_id", F.col("translated_text").alias("new"))
    best = own.where("__t != ''").groupBy("__t").agg(F.min(F.when(usable, order)).alias("x"), F.count("*").alias("n")).where("n > 1 and x is not null").select("__t", F.col("x.new").alias("__new"))
    out = own.join(best, "__t", "left")
    change = F.col("__new").isNotNull() & (F.col("status") != "EXCLUDED") & ~F.col("translated_text").eqNullSafe(F.col("__new"))
    out = out.withColumn("status", F.when(change, "MANUAL").otherwise(F.col("status"))).withColumn("translated_text", F.when(change, F.col("__new")).otherwise(F.col("translated_text")))
    return out.select(*items.columns)


def bulk_replaced(items: DataFrame, old: str, new: str, source: str, target: str, regex: bool = False) -> DataFrame:
    """The items with a text replaced in their translations, and those that changed validated again as manual texts."""
    out = replaced(items, "translated_text", old, new, regex)
    failure = rules.hard_failure(F.col("translated_text"), F.col("original_text"), source, target)
    status = F.when(F.col("changed") & failure.isNotNull(), "FAILED").when(F.col("changed"), "MANUAL").otherwise(F.col("status"))
    return out.withColumn("status", status)


def scoped(items: DataFrame, visible: DataFrame) -> DataFrame:
    """The items that were visible when a run began, by their ids."""
    return items.join(visible.select("segment_id").distinct(), "segment_id", "left_semi")


def looked_up(terms: DataFrame, key: str, term: str, lexicon: DataFrame) -> DataFrame:
    """(key, target, tier) of terms: the preferred entry of their surface, else of their reading.

    Preferred is an entry with a target, then one that is no name, then greater priority, then the earlier row; each
    tier's table has one row a term before it is joined."""
    order = [F.when(T.is_blank(F.col("target")), 1).otherwise(0), F.col("is_name").cast("int"), -F.col("priority"), F.col("row_id")]
    entries = lexicon.select("surface", "reading", "target", "is_name", "priority", "row_id")
    by_surface = best_entry(entries, "surface", order).select(F.col("surface").alias("__term"), F.struct("target").alias("__a"))
    by_reading = best_entry(entries.where("reading != ''"), "reading", order).select(F.col("reading").alias("__term"), F.struct("target").alias("__b"))
    own = terms.select(key, T.trimmed(F.col(term)).alias("__term")).join(by_surface, "__term", "left").join(by_reading, "__term", "left")
    tier = F.when(F.col("__a").isNotNull(), "surface").when(F.col("__b").isNotNull(), "reading")
    return own.select(key, F.when(F.col("__a").isNotNull(), F.col("__a.target")).otherwise(F.col("__b.target")).alias("target"), tier.alias("tier"))


def eligible_hints(entries: DataFrame, texts: DataFrame, text: str, phase_mask: int, version: int) -> DataFrame:
    """Cached hints (first_char, mask, version, ...) of a version and phase whose first character is in one of the texts."""
    chars = texts.select(F.explode(F.array_distinct(F.split(text, ""))).alias("first_char")).distinct()
    own = entries.where((F.col("mask").bitwiseAND(phase_mask) != 0) & (F.col("version") == version))
    return own.join(chars, "first_char", "left_semi")


def budgeted_targets(hints: DataFrame, group: str, order: list[Column], size: str, target: str, most: int, budget: int) -> DataFrame:
    """Per group, hints in order, each target once, while there are fewer than ``most`` and their sizes fit the budget.

    A target that was tried counts as used even where its size did not fit.  Repeats of a target are dropped by a window
    first; groups are provider batches, so the fold is over a bounded number."""
    w = Window.partitionBy(group, target).orderBy(*order)
    own = hints.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    rest = [c for c in own.columns if c != group]
    row = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col(size).cast("long").alias("size"), F.struct(*rest).alias("row"))
    rows = own.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("kept"))

    def step(a: Column, r: Column) -> Column:
        fits = (a["n"] < most) & (a["used"] + r["size"] <= budget)
        return F.struct((a["n"] + fits.cast("int")).alias("n"), F.when(fits, a["used"] + r["size"]).otherwise(a["used"]).alias("used"), F.concat(a["kept"], F.array(fits)).alias("kept"))

    kept = F.aggregate("rows", zero, step, lambda a: a["kept"])
    both = F.filter(F.zip_with("rows", kept, lambda r, k: F.struct(r["row"].alias("row"), k.alias("k"))), lambda x: x["k"])
    return rows.select(group, F.explode(both).alias("x")).select(group, "x.row.*")


def previous_values(segments: DataFrame, key: str, order: str, value: str, reset: Column) -> DataFrame:
    """The segments with the value of the segment before them; a segment that resets has none for its successor."""
    w = Window.partitionBy(key).orderBy(order)
    return segments.withColumn("previous", F.lag(F.when(~reset, F.col(value))).over(w))


def indirect_edits(references: DataFrame, sites: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits of literal sites (document_id, variable, key, start, length) whose value an indirect reference (document_id,
    namespace, variable, candidates, resolution) takes and which is renamed (namespace, key, value); and the renames that
    are blocked (no site) or for review (several candidates, or a namespace with unresolved references)."""
    own = references.where("kind = 'indirect'").withColumn("v", F.lower("variable"))
    each = own.select("document_id", "namespace", "v", "resolution", F.explode("candidates").alias("key")).join(renames, ["namespace", "key"])
    place = sites.select("document_id", F.lower("variable").alias("v"), "key", "start", "length").distinct()
    edits = each.join(place, ["document_id", "v", "key"]).select("document_id", "start", "length", "value").distinct()
    blocked = each.join(place, ["document_id", "v", "key"], "left_anti").select("namespace", "key", F.lit("blocked").alias("state"))
    several = each.where("resolution = 'ambiguous'").join(place, ["document_id", "v", "key"], "left_semi").select("namespace", "key", F.lit("review").alias("state"))
    loose = own.where("resolution = 'unresolved'").select("namespace").distinct()
    unsure = renames.join(loose, "namespace", "left_semi").select("namespace", "key", F.lit("review").alias("state"))
    return edits, blocked.union(several).union(unsure).groupBy("namespace", "key").agg(F.min("state").alias("state"))


def scan_metrics(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row of counters: documents, items, those of scripts, of tables and of identifiers, warnings, particle patterns."""
    d = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"), F.coalesce(F.sum("patterns"), F.lit(0)).alias("particle_patterns"))
    named = F.col("segment_type").startswith("identifier")
    i = items.agg(F.count("*").alias("items"), F.count_if(~named & (F.col("file_type") != "csv")).alias("script_items"), F.count_if(~named & (F.col("file_type") == "csv")).alias("csv_items"), F.count_if(named).alias("identifier_items"))
    return d.withColumn("__k", F.lit(1)).join(i.withColumn("__k", F.lit(1)), "__k").drop("__k")


def outcome_counts(outcomes: DataFrame, key: str) -> DataFrame:
    """(key, applied, noop, conflict, rejected) of submitted changes."""
    return outcomes.groupBy(key).agg(*(F.count_if(F.col("result") == r).alias(r.lower()) for r in ("Applied", "NoOp", "Conflict", "Rejected")))


def canonical_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of a payload: keys in order, no blanks, nulls written out."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def dictionary_payload(surface: Column, payload: Column) -> Column:
    """(reading, target) that a saved answer of an online dictionary in JSON gives for a surface, or null."""
    fields = ["surface", "entry", "headword", "word", "origin", "title", "koTarget", "mean", "meaning", "definition", "reading", "pronunciation"]
    nodes = F.from_json(F.concat(F.lit("["), F.regexp_replace(payload, r"(?s)^\s*\[(.*)\]\s*$", "$1"), F.lit("]")), "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>")
    first = lambda x, names: F.coalesce(*(F.nullif(F.trim(x[n]), F.lit("")) for n in names))
    found = F.transform(nodes, lambda x: F.struct(first(x, fields[:6]).alias("surface"), F.coalesce(first(x, fields[10:]), F.lit("")).alias("reading"), first(x, fields[6:10]).alias("target")))
    hit = F.get(F.filter(found, lambda x: (x["surface"] == F.trim(surface)) & x["target"].isNotNull()), F.lit(0))
    return F.when(hit.isNotNull(), F.struct(hit["reading"].alias("reading"), hit["target"].alias("target")))
