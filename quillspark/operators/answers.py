"""What saved answers of an online dictionary say: JSON of two kinds, and HTML pages."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import text as T
from quillspark.operators.items import dictionary_payload

# What a page holds that refuses an answer, what a meaning looks like, and the window it is looked for in.
BLOCKED = "(?i)captcha|자동입력|비정상적인 접근"
MEANING = r"[가-힣][가-힣\s\p{Z}·,()（）\-]{0,40}"
BEFORE, WINDOW = 1000, 6000
DICTIONARY = "jako"
LONG = 18


@F.pandas_udf(StringType())
def decoded(text: pd.Series) -> pd.Series:
    """The text with character entities put in, named ones and numbers."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def plain(text: Column) -> Column:
    """One line without tags, blanks around, or a number in front; the text is decoded already."""
    own = T.trimmed(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"[\s\p{Z}]+", " "))
    return T.trimmed(F.regexp_replace(own, r"^[0-9]+[.)]\s*", ""))


def completed(surface: Column, payload: Column) -> Column:
    """(reading, target) of the first candidate of an answer of completions, whose candidates are lists of lists."""
    sections = F.from_json(payload, "items array<array<array<string>>>")["items"]

    def value(c: Column, k: int) -> Column:
        own = F.get(c, F.lit(k))
        return F.coalesce(F.when(own.startswith("["), F.get_json_object(own, "$[0]")).otherwise(own), F.lit(""))

    found = F.transform(F.flatten(sections), lambda c: F.struct(T.trimmed(value(c, 0)).alias("reading"), T.trimmed(value(c, 1)).alias("surface"), plain(value(c, 3)).alias("target"), F.lower(value(c, 5)).alias("kind")))
    hit = F.get(F.filter(found, lambda x: (x["surface"] == surface) & (x["kind"] == DICTIONARY) & (x["target"] != "")), F.lit(0))
    return F.when(hit.isNotNull(), F.struct(hit["reading"].alias("reading"), hit["target"].alias("target")))


def on_page(surface: Column, page: Column) -> Column:
    """(reading, target) of a decoded page: the first meaning in a window about the surface; pages give no readings."""
    at = F.position(surface, page)
    window = F.substring(page, F.greatest(at - BEFORE, F.lit(1)), F.lit(WINDOW))
    meanings = F.filter(F.transform(F.regexp_extract_all(window, F.lit(MEANING), F.lit(0)), plain), lambda m: (m != "") & (m != surface))
    first = F.get(meanings, F.lit(0))
    return F.when((at > 0) & first.isNotNull(), F.struct(F.lit("").alias("reading"), first.alias("target")))


def answer(surface: Column, content: Column) -> Column:
    """(reading, target, review) that a saved answer gives for a surface, or null: none for blank input and for pages that
    refuse; a broken page or JSON gives what can be read of it.  ``review``: several meanings, or a long one."""
    own, page = T.trimmed(surface), decoded(content)
    json = F.coalesce(completed(own, content), dictionary_payload(own, content))
    got = F.when(T.trimmed(content).rlike(r"^[{\[]"), json).otherwise(on_page(own, page))
    usable = ~T.is_blank(surface) & ~T.is_blank(content) & ~content.rlike(BLOCKED) & got.isNotNull()
    review = got["target"].rlike("[;/；]") | (F.length(got["target"]) > LONG)
    return F.when(usable, F.struct(got["reading"].alias("reading"), got["target"].alias("target"), review.alias("review")))
