"""Rules on items and terms: identifiers, failures, language exclusion, hint scores, priorities, deinflection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.lexicon import ngrams
from quillspark.sources.syntax import INDEXED_CALL, SYMBOL

# Fixed values.
RESOURCE_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "webp", "bmp", "apng", "ogg", "wav", "mp3", "mid", "midi",
    "ttf", "otf", "woff", "woff2", "txt", "dat", "csv", "xml", "html", "htm", "json",
]
INVALID_IDENTIFIER = r"[\r\n:：,，、()（）\[\]［］{}｛｝%％\"'`<>＜＞=＝+\-*/\\&|!！?？;；#＃]"
PRIORITIES = {"news1": 500, "ichi1": 500, "spec1": 400, "gai1": 400, "news2": 300, "ichi2": 300, "spec2": 250, "gai2": 250}
DEINFLECTIONS = [
    ("した", "する"),
    ("した", "す"),
    ("して", "する"),
    ("して", "す"),
    ("しない", "する"),
    ("します", "する"),
    ("された", "する"),
    ("された", "す"),
    ("される", "する"),
    ("される", "す"),
    ("されて", "する"),
    ("されて", "す"),
    ("ない", "る"),
    ("なかった", "る"),
    ("ます", "る"),
    ("ました", "る"),
    ("ません", "る"),
]
TERM_CHARS = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{3005}\x{3006}\x{30F6}\x{30FC}\x{30FB}"


def looks_like_resource_path(text: Column) -> Column:
    own = F.regexp_replace(F.trim(text), r'^@?"(.*)"$', "$1")
    name = F.trim(F.substring_index(F.replace(F.regexp_replace(own, T.PLACEHOLDER, "SEG"), F.lit("\\"), F.lit("/")), "/", -1))
    return F.coalesce((name != "") & ~name.rlike(r"[ \t]") & name.rlike(rf"(?i)\.({'|'.join(RESOURCE_EXTENSIONS)})$"), F.lit(False))


def identifier_text(text: Column) -> Column:
    return F.when(T.is_blank(text), "").otherwise(F.regexp_replace(T.full_width_spacing(text), r"[\s\p{Z}]+", ""))


def identifier_failure(text: Column) -> Column:
    return F.when(T.is_blank(text), "blank").when(text.rlike(INVALID_IDENTIFIER), "invalid_character")


def source_leak(translated: Column, original: Column, source: str, target: str) -> Column:
    """Whether a translation from Japanese to Korean still holds the source: its characters, or all of the original."""
    if source not in ("ja", "jp") or target != "ko":
        return F.lit(False)
    own = F.regexp_replace(F.regexp_replace(translated, INDEXED_CALL, ""), SYMBOL, "")
    same = F.regexp_replace(own, r"[\s\p{Z}]+", "") == F.regexp_replace(original, r"[\s\p{Z}]+", "")
    unchanged = ~T.is_blank(original) & T.contains_language(original, "ja") & ~T.contains_language(own, "ko") & same
    return T.contains_language(own, "ja") | F.coalesce(unchanged, F.lit(False))


def hard_failure(translated: Column, original: Column, source: str, target: str) -> Column:
    return F.when(T.is_blank(translated), "blank").when(source_leak(translated, original, source, target), "source_language")


def normalized(translated: Column, file_type: Column, is_identifier: Column, preserve: Column) -> Column:
    """A translation in the form of its item's kind: identifiers without blanks, CSV and script texts by their rules.

    The separators of script calls are put right by ``responses.argument_separators`` where a text has calls."""
    return F.when(is_identifier, identifier_text(translated)).when(file_type == "csv", T.csv_text(translated, preserve)).otherwise(T.full_width_spacing(translated))


def resolved(translated: Column, original: Column, source: str, target: str, is_identifier: Column | None = None) -> Column:
    """(status, reason) of a normalised translation: failed, for review, or done; identifiers have a rule of their own."""
    named = F.lit(False) if is_identifier is None else is_identifier
    failure = F.when(named, identifier_failure(translated)).otherwise(hard_failure(translated, original, source, target))
    review = F.when(~named, T.review_reason(original, translated))
    status = F.when(failure.isNotNull(), "FAILED").when(review.isNotNull(), "NEEDS_REVIEW").otherwise("DONE")
    return F.struct(status.alias("status"), F.coalesce(failure, review).alias("reason"))


def language_filter(original: Column, translated: Column, status: Column, source: str, target: str, enabled: bool = True) -> Column:
    """The action on an item: restore one that was excluded by this filter before, and then reuse an original in the
    target language as its own translation, or exclude one that is not in the source language."""
    restored = status == "AUTO_EXCLUDED"
    open_ = restored | (T.is_blank(translated) & status.isin("PENDING", "FAILED", "STOPPED"))
    if not enabled:
        return F.when(restored, "restore")
    return F.when(open_ & T.is_entirely_language(original, target), "reuse").when(open_ & ~T.is_likely_language(original, source), "exclude").when(restored, "restore")


def hint_score(source: Column, bundled: Column, prompting: Column, reference: Column, identifier: Column, priority: Column, name: Column, status: Column) -> Column:
    """The static score of a glossary hint, before it is matched with a text."""
    long = F.length(source) * 3
    from_bundle = F.greatest(F.lit(0), F.least(F.lit(20), F.floor(priority / 500))) + F.when(source.rlike(r"[\x{3400}-\x{9FFF}]"), 10).otherwise(0) - F.when(name, 20).otherwise(0)
    return (
        F.when(bundled, long + 55 + from_bundle).otherwise(long + 100)
        + F.when(prompting, 30).otherwise(0)
        + F.when(reference, 20).otherwise(0)
        + F.when(identifier, 15).otherwise(0)
        + F.when(status == "MANUAL", 20).when(status == "NEEDS_REVIEW", -25).otherwise(0)
    ).cast("int")


def tag_priority(tags: Column) -> Column:
    """The greatest score of an entry's priority tags; nfNN scores 200 - NN, any other tag 100, none 0."""
    table = F.create_map(*(F.lit(x) for pair in PRIORITIES.items() for x in pair))

    def score(tag: Column) -> Column:
        own = F.trim(tag)
        rank = F.regexp_extract(own, r"^nf([0-9]{1,9})$", 1).try_cast("int")
        return F.coalesce(F.try_element_at(table, own), F.when(rank.isNotNull(), F.greatest(F.lit(1), 200 - rank)), F.lit(100))

    return F.coalesce(F.array_max(F.transform(tags, score)), F.lit(0))


def term_candidates(text: Column, shortest: int, longest: int) -> Column:
    """The strings of shortest to longest characters in runs of term characters, and base forms they may be inflections of."""
    runs = F.regexp_extract_all(text, F.lit(f"[{TERM_CHARS}]+"), F.lit(0))
    grams = F.flatten(F.transform(runs, lambda r: F.transform(ngrams(r, longest, shortest), lambda g: g["gram"])))

    def forms(x: Column) -> Column:
        return F.array(x, *(F.when(x.endswith(e) & (F.length(x) > len(e)), F.concat(F.left(x, F.length(x) - len(e)), F.lit(b))) for e, b in DEINFLECTIONS))

    every = F.array_compact(F.flatten(F.transform(grams, forms)))
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: F.length(x).between(shortest, longest))))
