"""Lexicon and glossary operators: containment joins without cross products, tiers of lookup, budgeted choice."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of terms that are sent to all tasks.
BROADCAST = 1 << 20
#: First characters of terms that substrings are chosen by; where there are more, all substrings are looked up.
FIRSTS = 4096


def ngrams(text: Column, longest: int, shortest: int = 1) -> Column:
    """All substrings of shortest to longest characters as (start, gram)."""
    size = F.length(text)

    def from_place(i: Column) -> Column:
        last = F.least(F.lit(longest), size - i)
        none = F.array().cast("array<struct<start:int,gram:string>>")
        return F.when(last >= shortest, F.transform(F.sequence(F.lit(shortest), F.greatest(last, F.lit(shortest))), lambda n: F.struct(i.alias("start"), F.substring(text, i + 1, n).alias("gram")))).otherwise(none)

    return F.when(size > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), from_place))).otherwise(F.array().cast("array<struct<start:int,gram:string>>"))


def contained_terms(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str, longest: int) -> DataFrame:
    """(key, start, term) of every occurrence of a term of at most ``longest`` characters in a text.

    Substrings of the lengths that terms have, and only those, are joined with the terms as equal strings, whatever the
    number of terms; the lengths are ``longest`` numbers at most.  A few terms, of BROADCAST characters at most, are sent to
    all tasks; otherwise both sides are dealt by term, as the substrings must never be sent, however small their file is."""
    own = terms.select(F.col(term)).where(F.length(term).between(1, longest)).distinct()
    counts = dict(own.groupBy(F.length(term)).count().collect())
    lengths = sorted(counts)
    firsts = [r[0] for r in own.select(F.substring(term, 1, 1)).distinct().limit(FIRSTS + 1).collect()]
    size = F.length(text)
    # a substring that begins as no term does is none
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    if firsts and len(firsts) <= FIRSTS:
        places = F.filter(places, lambda i: F.substring(F.col(text), i + 1, F.lit(1)).isin(firsts))

    def of_length(n: int) -> Column:
        return F.transform(F.filter("__places", lambda i: i <= size - n), lambda i: F.struct(i.alias("start"), F.substring(F.col(text), i + 1, F.lit(n)).alias(term)))

    none = F.array().cast(f"array<struct<start: int, `{term}`: string>>")
    texts = texts.select(key, text, places.alias("__places"))
    rows = texts.select(key, F.explode(F.concat(none, *map(of_length, lengths))).alias("g")).select(key, "g.*")
    few = sum(n * c for n, c in counts.items()) <= BROADCAST
    return rows.join(F.broadcast(own), term) if few else rows.hint("merge").join(own, term)


def term_runs(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """(key, term, n) of terms that are runs of whole words of a text: word n-grams of the lengths that terms have."""
    lengths = terms.agg(F.sort_array(F.collect_set(F.size(F.split(term, " "))))).first()[0] or [1]
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    rows = texts.select(key, words.alias("w"))
    grams = F.flatten(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))))
    return rows.select(key, F.explode(grams).alias(term)).join(terms.select(term).distinct(), term).groupBy(key, term).agg(F.count("*").alias("n"))


def sharing_characters(entries: DataFrame, first_char: str, texts: DataFrame, text: str) -> DataFrame:
    """Entries whose first character occurs in any of the texts."""
    chars = texts.select(F.explode(F.array_distinct(F.split(text, ""))).alias(first_char)).distinct()
    return entries.join(chars, first_char, "left_semi")


def best_entry(lexicon: DataFrame, surface: str, order: list[Column]) -> DataFrame:
    """The preferred entry of each surface."""
    rest = [c for c in lexicon.columns if c != surface]
    ranked = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*rest).alias("row"))
    return lexicon.groupBy(surface).agg(F.min(ranked).alias("x")).select(surface, "x.row.*")


def one_target_terms(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """Sources with one distinct target only, longest first."""
    out = pairs.groupBy(source).agg(F.min(target).alias(target), F.max(target).alias("__b")).where(F.col(target) == F.col("__b")).drop("__b")
    return out.orderBy(F.length(source).desc(), source)


def budgeted(hints: DataFrame, group: str, order: list[Column], size: str, most: int, budget: int) -> DataFrame:
    """Per group, hints in order while there are fewer than ``most`` and their sizes fit the budget; a hint that does
    not fit is skipped and later, smaller ones may still be taken.  A fold over the group's ordered candidates."""
    rest = [c for c in hints.columns if c != group]
    row = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col(size).cast("long").alias("size"), F.struct(*rest).alias("row"))
    # most * group rows would do only without skipping, so the whole group is folded; groups are batches of bounded size
    rows = hints.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))
    sizes = F.transform("rows", lambda r, i: F.struct(i.alias("i"), r["size"].alias("size")))
    kept = F.aggregate(
        sizes,
        zero,
        lambda a, r: F.when((a["n"] < most) & (a["used"] + r["size"] <= budget), F.struct((a["n"] + 1).alias("n"), (a["used"] + r["size"]).alias("used"), F.concat(a["kept"], F.array(r["i"])).alias("kept"))).otherwise(a),
        lambda a: a["kept"],
    )
    picked = rows.select(group, F.explode(F.transform(kept, lambda i: F.get("rows", i))).alias("x"))
    return picked.select(group, "x.row.*")


def ranked(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def free_range_choice(matches: DataFrame, group: str) -> DataFrame:
    """Of matches (group, source, priority, score, ranges of (text_id, start, end)), in order of priority, length, score
    and source, those with a range that is still free; a match that is taken occupies all its ranges.

    Groups are provider batches, whose size is bounded; a task reads many of them at a time."""
    own = F.sort_array(F.collect_list(F.struct("priority", F.length("source").alias("size"), "score", "source", "ranges")))
    groups = matches.groupBy(group).agg(own.alias("rows"))

    def order(row: dict) -> tuple:
        """What is null comes last."""
        return *((row[c] is None, -(row[c] or 0)) for c in ("priority", "size", "score")), row["source"] is None, row["source"] or ""

    def choose(rows: list[dict]) -> Iterator[str]:
        taken: dict = {}
        for row in sorted(rows, key=order):
            ranges = row["ranges"]
            if all(any(r["start"] < b and a < r["end"] for a, b in taken.get(r["text_id"], ())) for r in ranges):
                continue
            yield row["source"]
            for r in ranges:
                taken.setdefault(r["text_id"], []).append((r["start"], r["end"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(k, source) for k, rows in enumerate(batch.column("rows").to_pylist()) for source in choose(rows)]
            at, sources = zip(*kept, strict=True) if kept else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(group).take(pa.array(at, pa.int64())), pa.array(sources, pa.string())], names=[group, "source"])

    kind = matches.schema[group].dataType.simpleString()
    return groups.mapInArrow(run, f"`{group}` {kind}, source string")


def import_dictionary(lines: DataFrame, line: str, modes: dict[str, str], enabled: dict[str, bool], header: str) -> DataFrame:
    """(source, target, mode, is_enabled, skipped) of tab-separated dictionary lines; a line that does not fit is
    skipped, headers and blank lines are left out.  Escapes are backslash t, n and backslash."""
    fields = F.split(F.regexp_replace(line, "\r$", ""), "\t", -1)

    def plain(x: Column) -> Column:
        mark = F.replace(x, F.lit("\\\\"), F.lit("\u0001"))
        return F.trim(F.replace(F.replace(F.replace(mark, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\u0001"), F.lit("\\")))

    as_mode = F.create_map(*(F.lit(x) for pair in modes.items() for x in pair))
    as_flag = F.create_map(*(F.lit(x) for pair in enabled.items() for x in pair))
    own = lines.where((F.trim(line) != "") & ~F.col(line).startswith(header)).select(fields.alias("f"))
    out = own.select(
        plain(F.get("f", F.lit(0))).alias("source"),
        plain(F.get("f", F.lit(1))).alias("target"),
        F.try_element_at(as_mode, F.trim(F.get("f", F.lit(2)))).alias("mode"),
        F.try_element_at(as_flag, F.trim(F.get("f", F.lit(3)))).alias("is_enabled"),
        (F.size("f") == 4).alias("whole"),
    )
    fits = F.col("whole") & F.col("mode").isNotNull() & F.col("is_enabled").isNotNull() & (F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != "")
    return out.withColumn("skipped", ~F.coalesce(fits, F.lit(False))).drop("whole")
