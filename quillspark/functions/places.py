"""Matches of a pattern with their places in the text, and putting new text in such places, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = "array<struct<start:int,length:int,value:string>>"
BLOCK = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums(steps: Column) -> Column:
    """Sums of an array of ints up to each element, by blocks, so that no long array is grown step by step."""
    empty = F.array().cast("array<int>")

    def grown(part: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), empty.alias("all"))
        return F.aggregate(part, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"] + x)).alias("all")))

    def joined(a: Column, part: Column) -> Column:
        return bound(grown(part, a["at"]), lambda p: F.struct(p["at"].alias("at"), F.concat(a["all"], F.array(p["all"])).alias("all")))

    def whole(own: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda b: F.slice(own, b * BLOCK + 1, BLOCK))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("all"))
        return F.when(F.size(own) <= BLOCK, grown(own, F.lit(0))["all"]).otherwise(F.flatten(F.aggregate(blocks, zero, joined, lambda a: a["all"])))

    return bound(steps, whole)


def found(text: Column, pattern: str) -> Column:
    """The matches of a pattern (which matches no empty string) as (start, length, value), leftmost first."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(x: Column) -> Column:
        steps = F.zip_with(x["hits"], F.slice(x["gaps"], 1, F.size(x["hits"])), lambda h, g: F.length(h) + F.length(g))
        return F.zip_with(x["hits"], sums(steps), lambda h, end: F.struct((end - F.length(h)).alias("start"), F.length(h).alias("length"), h.alias("value")))

    none = F.array().cast(PLACES)
    return F.when(text.rlike(pattern), bound(F.struct(hits.alias("hits"), gaps.alias("gaps")), placed)).otherwise(none).cast(PLACES)


def replaced(text: Column, pattern: str, value: Callable[[Column], Column]) -> Column:
    """The text with each match of a pattern replaced by value(match)."""
    hits = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit(None).cast("string")))
    parts = F.zip_with(F.split(text, pattern, -1), hits, lambda g, h: F.concat(g, F.when(h.isNull(), "").otherwise(value(h))))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


def beyond(text: Column) -> Column:
    """The places of the characters that take two UTF-16 units."""
    return F.transform(found(text, r"[\x{10000}-\x{10FFFF}]"), lambda h: h["start"])


def to_utf16(place: Column, wide: Column) -> Column:
    """A place in code points as one in UTF-16 units; ``wide`` are the text's places ``beyond``, worked out once a text."""
    return place + F.size(F.filter(wide, lambda w: w < place))


def from_utf16(unit: Column, wide: Column) -> Column:
    """A place in UTF-16 units as one in code points; a place inside a pair is that of its character."""
    return unit - F.size(F.filter(F.transform(wide, lambda w, i: w + i), lambda u: u < unit))
