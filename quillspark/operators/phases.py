"""Phases of translation: which phase an item is in, what may be looked up or serve as a hint, and the loop over batches.

Items have file_type (csv, script, header), segment_type, is_reference_key, original_text, translated_text, status,
validation and can_save."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import placeholders
from quillspark.functions import text as T
from quillspark.functions.rules import normalized, resolved
from quillspark.operators.grouping import only_one
from quillspark.operators.lexicon import budgeted, contained_terms
from quillspark.plans.shared import saved
from quillspark.sources.syntax import looks_like_symbol_expression

# Phases in order, the bits of their masks, and limits of glossary terms.
PHASES = ["csv_reference_keys", "csv_general", "identifiers", "header", "script"]
MASKS = {phase: 1 << k for k, phase in enumerate(PHASES)}
SOURCE_CHARS, TARGET_CHARS = 40, 80
#: Rows that a task numbers.
NUMBERED = 1 << 15
SENTENCE = "[。！？!?'\"]"
SUCCESS = ["DONE", "NEEDS_REVIEW", "MANUAL"]
STOPPED = "STOPPED"
OPEN = ["PENDING", "FAILED", STOPPED]


def is_identifier(segment_type: Column) -> Column:
    return segment_type.startswith("identifier")


def phase(file_type: Column, segment_type: Column, is_reference_key: Column) -> Column:
    csv = file_type == "csv"
    return F.when(csv & is_reference_key, PHASES[0]).when(csv, PHASES[1]).when(is_identifier(segment_type), PHASES[2]).when(file_type == "header", PHASES[3]).otherwise(PHASES[4])


def is_success(status: Column, validation: Column, can_save: Column, translated: Column) -> Column:
    return status.isin(SUCCESS) & (validation == "PASS") & can_save & ~T.is_blank(translated)


def looked_up_first(original: Column, is_reference_key: Column, longest: int = 12) -> Column:
    """Whether a dictionary is asked before a provider: keys, and short terms that are no sentences."""
    own = T.trimmed(original)
    plain = ~T.is_blank(own) & ~own.rlike(r"[\r\n]") & ~T.is_numeric_like(own) & ~T.looks_like_code_only(own) & ~looks_like_symbol_expression(own) & T.contains_translatable(own)
    term = ~own.rlike(SENTENCE) & ~own.rlike(r"[\s\p{Z}]") & (T.visible_length(own) <= max(1, min(longest, 12)))
    return plain & (is_reference_key | term)


def glossary_mask(file_type: Column, segment_type: Column, is_reference_key: Column) -> Column:
    """The phases that an item may be a hint in: those after its own."""
    csv = F.when(is_reference_key, sum(MASKS[p] for p in PHASES[1:])).otherwise(0)
    return F.when(file_type == "csv", csv).when(is_identifier(segment_type), MASKS["header"] + MASKS["script"]).when(file_type == "header", MASKS["script"]).otherwise(0)


def glossary_source(original: Column, translated: Column, success: Column) -> Column:
    """Whether an item may be a hint: translated, on one line, short, and no markup, code or number."""
    broken = r"[\r\n]"
    fits = (F.length(T.trimmed(original)) <= SOURCE_CHARS) & (F.length(T.trimmed(translated)) <= TARGET_CHARS) & ~original.rlike(broken) & ~translated.rlike(broken)
    no_markup = ~original.rlike("|".join(f"(?:{p})" for p in placeholders.PATTERNS))
    return success & ~T.is_blank(original) & ~T.is_blank(translated) & fits & no_markup & ~T.looks_like_code_only(original) & ~looks_like_symbol_expression(original) & ~T.is_numeric_like(original)


def writable(status: Column, validation: Column, can_save: Column, original: Column, translated: Column) -> Column:
    """Whether an item is written out: excluded ones keep their original, others need a valid translation."""
    excluded = can_save & validation.isin("AUTO_EXCLUDED", "MANUAL_EXCLUDED") & ~T.is_blank(original)
    return F.when(status == "EXCLUDED", excluded).otherwise(~T.is_blank(translated) & can_save & (validation == "PASS"))


def phase_counts(items: DataFrame) -> DataFrame:
    """(phase, items, pending, done, remaining) of items with a phase and a status."""
    return items.groupBy("phase").agg(
        F.count("*").alias("items"), F.count_if(F.col("status") == "PENDING").alias("pending"),
        F.count_if(F.col("status").isin(SUCCESS)).alias("done"), F.count_if(F.col("status").isin(OPEN)).alias("remaining"),
    )


def batch_summary(items: DataFrame, keys: list[str], text: str, path: str) -> DataFrame:
    """(keys, chars, files, more): characters of a batch, its first two files by name, and whether there are more."""
    each = items.groupBy(*keys, path).agg(F.sum(F.length(text)).alias("chars"))
    first = each.groupBy(*keys).agg(F.sum("chars").alias("chars"), F.min(path).alias("__first"), F.count(path).alias("__files"))
    second = each.join(first.select(*keys, "__first"), keys).where(F.col(path) > F.col("__first")).groupBy(*keys).agg(F.min(path).alias("__second"))
    files = F.concat_ws(", ", "__first", "__second")
    return first.join(second, keys, "left").select(*keys, "chars", files.alias("files"), (F.col("__files") > 2).alias("more"))


def representatives(items: DataFrame) -> DataFrame:
    """One item for each original text: the first that waits for a translation, in order of path, line and id."""
    waits = items.where(F.col("status").isin(OPEN))
    first = F.min(F.struct("relative_path", "line_number", "segment_id")).alias("x")
    return waits.groupBy("original_text").agg(first).select("original_text", F.col("x.segment_id").alias("segment_id"), F.col("x.relative_path").alias("relative_path"), F.col("x.line_number").alias("line_number"))


def numbered(rows: DataFrame, group: str, order: list[str], most: int = NUMBERED) -> DataFrame:
    """The rows with their number (from 1) in their group, in an order that tells them apart.  They are dealt to tasks of about
    ``most`` rows by ranges of the order; each range is numbered on its own, from where the group's ranges before it end, so
    no group is sorted by one task."""
    spread = saved(rows, "numbered-rows")
    parts = math.ceil(spread.count() / most)
    if parts <= 1:
        return spread.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    ranged = saved(spread.repartitionByRange(parts, group, *order).withColumn("__part", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(group, "__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n").withColumnRenamed("__part", "__range")
    own = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))
    out = ranged.withColumn("__own", own).withColumnRenamed(group, "__group")
    same = F.col("__group").eqNullSafe(F.col(group)) & (F.col("__part") == F.col("__range"))
    return out.join(starts, same).select(*rows.columns, (F.col("__own") + F.col("__before")).cast("int").alias("number"))


Provider = Callable[[DataFrame], DataFrame]


def translated(items: DataFrame, provider: Provider, source: str, target: str, batch_size: int = 10, retries: int = 1, hints: DataFrame | None = None, most_hints: int = 8, hint_chars: int = 360) -> DataFrame:
    """The items with status, reason and translated_text after a run of the loop.

    One item of each text is asked for.  ``provider`` is a function from requests (segment_id, text, batch, attempt) to
    answers (segment_id, translated, error), run on the cluster, for instance by mapInPandas.  An answer that is missing,
    is an error or has lost a token is asked for again, ``retries`` times at most; what is left then failed.  Answers are
    restored, normalised and validated for every item of their text.  An answer with the error STOPPED (``providers.Ledger``)
    leaves its items STOPPED, and a later run asks for them.

    With ``hints`` (source, target) requests have a column hints besides: (source, target) of the terms that their text
    holds, at most ``most_hints`` of at most ``hint_chars`` characters, longest first."""
    asked = placeholders.protected(representatives(items), "original_text", "p")
    asked = numbered(asked.select("segment_id", "original_text", "relative_path", "line_number", "p.text", "p.placeholders"), "relative_path", ["line_number", "segment_id"])
    asked = saved(asked.select("segment_id", "original_text", "text", "placeholders", F.floor((F.col("number") - 1) / batch_size).alias("batch")), "requests")
    left, done = asked, None
    for attempt in range(max(0, min(retries, 10)) + 1):
        requests = left.select("segment_id", "text", "batch", F.lit(attempt).alias("attempt"))
        # a provider may read its requests more than once
        answers = provider(requests if hints is None else saved(with_hints(requests, asked, hints, most_hints, hint_chars), f"hinted-{attempt}"))
        got = left.join(answers, "segment_id", "left")
        repaired = placeholders.repair_tokens(F.col("translated"), F.col("placeholders"))
        lost = placeholders.token_error(repaired, F.col("placeholders"))
        percent = F.exists("placeholders", lambda x: x.startswith("%") & x.endswith("%") & (F.length(x) >= 2))
        reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("translated").isNull(), "missing result").when(lost.isNotNull(), F.when(percent, "damaged variable").otherwise("lost token"))
        got = saved(got.select(*left.columns, reason.alias("reason"), placeholders.restore(F.col("translated"), F.col("placeholders")).alias("translated")), f"answers-{attempt}")
        last = attempt == max(0, min(retries, 10))
        # what was stopped is not asked for again in this run
        settled = got if last else got.where(F.col("reason").isNull() | (F.col("reason") == STOPPED))
        done = settled if done is None else done.unionByName(settled)
        left = got.where(F.col("reason") != STOPPED).select(*left.columns)
    found = done.select("original_text", F.col("reason").alias("failure"), "translated", F.lit(True).alias("asked"))
    out = items.join(found, "original_text", "left")
    own = normalized(F.col("translated"), F.col("file_type"), is_identifier(F.col("segment_type")), F.lit(False))
    out = out.withColumn("own", F.when(F.col("failure").isNull(), own))
    state = resolved(F.col("own"), F.col("original_text"), source, target, is_identifier(F.col("segment_type")))
    # manual texts and manual exclusions are not touched
    touched = F.col("asked") & ~F.col("status").isin("MANUAL", "EXCLUDED")
    stopped = F.col("failure") == STOPPED
    status = F.when(touched & stopped, STOPPED).when(touched & F.col("failure").isNotNull(), "FAILED").when(touched, state["status"]).otherwise(F.col("status"))
    why = F.when(touched, F.coalesce("failure", state["reason"]))
    text = F.when(touched & F.col("failure").isNull(), F.col("own")).otherwise(F.col("translated_text"))
    return out.withColumn("reason", why).withColumn("translated_text", text).withColumn("status", status).select(*items.columns, "reason")


def with_hints(requests: DataFrame, asked: DataFrame, hints: DataFrame, most: int, chars: int) -> DataFrame:
    """The requests with the hints of their original texts; terms are found by equal runs of characters of their lengths."""
    texts = asked.select("segment_id", "original_text")
    found = contained_terms(texts, "segment_id", "original_text", hints, "source", SOURCE_CHARS).select("segment_id", "source").distinct().join(hints, "source")
    own = found.withColumn("size", F.length("source") + F.length("target"))
    chosen = budgeted(own, "segment_id", [-F.length("source"), F.col("source")], "size", most, chars)
    listed = chosen.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("hints"))
    none = F.array().cast("array<struct<source: string, target: string>>")
    return requests.join(listed, "segment_id", "left").withColumn("hints", F.coalesce("hints", none))


def glossary(items: DataFrame, phase_name: str) -> DataFrame:
    """(source, target) of the hints for a phase: what earlier phases translated that may be one there, each source with its
    only target.  Items have file_type, segment_type, is_reference_key, validation and can_save besides."""
    good = is_success(F.col("status"), F.col("validation"), F.col("can_save"), F.col("translated_text"))
    fits = glossary_source(F.col("original_text"), F.col("translated_text"), good)
    mask = glossary_mask(F.col("file_type"), F.col("segment_type"), F.col("is_reference_key")).bitwiseAND(F.lit(MASKS[phase_name]))
    own = items.where(fits & (mask != 0)).select(T.trimmed(F.col("original_text")).alias("source"), T.trimmed(F.col("translated_text")).alias("target"))
    return only_one(own, ["source"], "target")


def by_phases(items: DataFrame, provider: Provider, source: str, target: str, feed: bool = False, **options) -> DataFrame:
    """The loop over the phases in order; a later phase has the results of those before it (items have a phase).  With
    ``feed`` the glossary is made anew before each phase from what is translated by then, and its requests carry hints."""
    done = None
    for name in PHASES:
        own = items.where(F.col("phase") == name)
        if own.isEmpty():
            continue
        known = None if done is None else only_one(done.where(F.col("status").isin(SUCCESS)), ["original_text"], "translated_text").withColumnRenamed("translated_text", "__a")
        if known is not None:
            own = own.join(known, "original_text", "left")
            take = F.col("__a").isNotNull() & F.col("status").isin(OPEN)
            own = own.withColumn("translated_text", F.when(take, F.col("__a")).otherwise(F.col("translated_text"))).withColumn("status", F.when(take, "DONE").otherwise(F.col("status"))).select(*items.columns)
        own_hints = {"hints": saved(glossary(done, name), f"hints-{name}")} if feed and done is not None else {}
        result = saved(translated(own, provider, source, target, **own_hints, **options), f"phase-{name}")
        done = result if done is None else done.unionByName(result)
    return items.where("false").withColumn("reason", F.lit(None).cast("string")) if done is None else done
