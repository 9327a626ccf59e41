"""Operators on text intervals: running offsets, non-overlapping choice, interval anti joins and applying edits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """One row a line: line_no from 0, offset of its first character, and the line.

    The offset is a running sum over the lines of a document, one window by document."""
    carry = [id_col] if carry is None else carry
    parts = F.split(F.col(text_col), "\n", -1)
    rows = docs.select(*carry, F.posexplode(parts).alias("line_no", "line"))
    before = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))


def non_overlapping(spans: Column) -> Column:
    """Of an array of (start, length, ...): by start, longer first, those that begin at or after the last end taken.

    A span is taken if it begins at or after the greatest end taken before it; the fold keeps the numbers of the spans
    taken, and the sorted array is worked out once."""

    def before(a: Column, b: Column) -> Column:
        by_start = F.sign(a["start"] - b["start"]).cast("int")
        return F.when(a["start"] != b["start"], by_start).otherwise(F.sign(b["length"] - a["length"]).cast("int"))

    def chosen(ordered: Column) -> Column:
        zero = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("end"), F.array().cast("array<int>").alias("kept"))

        def step(a: Column, x: Column) -> Column:
            free = x["start"].cast("long") >= a["end"]
            end = F.when(free, (x["start"] + x["length"]).cast("long")).otherwise(a["end"])
            return F.struct((a["i"] + 1).alias("i"), end.alias("end"), F.when(free, F.concat(a["kept"], F.array(a["i"]))).otherwise(a["kept"]).alias("kept"))

        return F.transform(F.aggregate(ordered, zero, step, lambda a: a["kept"]), lambda i: F.get(ordered, i))

    return F.element_at(F.transform(F.array(F.array_sort(spans, before)), chosen), 1)


def last_per_place(spans: Column) -> Column:
    """Of spans of equal (start, length), the last in the array only."""

    def own(xs: Column) -> Column:
        return F.filter(xs, lambda x, i: ~F.exists(F.slice(xs, i + 2, F.size(xs)), lambda y: (y["start"] == x["start"]) & (y["length"] == x["length"])))

    return F.element_at(F.transform(F.array(spans), own), 1)


def cells(start: Column, length: Column, bucket: int) -> Column:
    """The buckets of ``bucket`` characters that a range lies in."""
    return F.sequence(F.floor(start / bucket), F.floor((start + F.greatest(length, F.lit(1)) - 1) / bucket))


def without_overlap(edits: DataFrame, taken: DataFrame, key: str, bucket: int = 4096) -> DataFrame:
    """Edits (key, start, length, ...) that meet no range of ``taken`` (key, start, length) of the same key.

    Both sides are dealt to buckets of ``bucket`` characters, so that the interval condition is checked within equal
    (key, bucket) pairs only, however many ranges a key has.  Equal edits are kept as often as they come."""
    own = edits.groupBy(*edits.columns).agg(F.count("*").alias("__times"))
    spread = own.withColumn("__cell", F.explode(cells(F.col("start"), F.col("length"), bucket)))
    b = taken.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("length").alias("__n"), F.explode(cells(F.col("start"), F.col("length"), bucket)).alias("__c"))
    meet = (F.col(key) == F.col("__k")) & (F.col("__cell") == F.col("__c")) & (F.col("start") < F.col("__s") + F.col("__n")) & (F.col("__s") < F.col("start") + F.col("length"))
    free = spread.join(b, meet, "left").groupBy(*edits.columns, "__times").agg(F.count("__s").alias("__met")).where("__met = 0")
    return free.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*edits.columns)


def inside(ranges: DataFrame, outer: DataFrame, key: str, bucket: int = 4096) -> DataFrame:
    """The distinct (key, start, length) of ranges that lie inside one of ``outer``: the one that holds the first cell does."""
    a = ranges.select(key, "start", "length").distinct().withColumn("__cell", F.floor(F.col("start") / bucket))
    b = outer.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("length").alias("__n"), F.explode(cells(F.col("start"), F.col("length"), bucket)).alias("__c"))
    holds = (F.col(key) == F.col("__k")) & (F.col("__cell") == F.col("__c")) & (F.col("__s") <= F.col("start")) & (F.col("start") + F.col("length") <= F.col("__s") + F.col("__n"))
    return a.join(b, holds, "left_semi").select(key, "start", "length")


def apply_edits(text: Column, edits: Column) -> Column:
    """The text with (start, length, value) replaced; edits are sorted and disjoint, so the kept parts are joined."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, e: Column) -> Column:
        return F.struct(
            (e["start"] + e["length"]).cast("int").alias("at"),
            F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, (e["start"] - a["at"]).cast("int")), e["value"])).alias("parts"),
        )

    return F.aggregate(edits, zero, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def nesting_depth(rows: DataFrame, key: str, order: str, opens: Column, closes: Column) -> DataFrame:
    """The rows with depth: how many openings are open before each row."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("depth", F.coalesce(F.sum(opens.cast("int") - closes.cast("int")).over(before), F.lit(0)))


STACK_BLOCK = 4096


def stack_contents(rows: DataFrame, key: str, order: str, value: str, opens: str, closes: str, block: int = STACK_BLOCK) -> DataFrame:
    """The rows (key, order, value, opens, closes) with ``stack``: the values that are open before each, outermost first.

    A row that closes takes the innermost value off (none, if the stack is empty), one that opens puts its own on; one that
    does both closes first.  ``order`` are integers.  Rows are dealt to blocks of ``block`` numbers; what a block does to any
    stack is how many values it takes off and which it leaves, so the stacks at the starts of blocks follow from those
    summaries alone, and no script, however long, is one task."""
    own = rows.withColumn("__block", F.floor(F.col(order) / block))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [key, order, value, opens, closes]

    def moves(part: pd.DataFrame) -> Iterator[tuple[bool, bool, object]]:
        ordered = part.sort_values(order)
        yield from zip(ordered[opens], ordered[closes], ordered[value], strict=True)

    def summary(part: pd.DataFrame) -> pd.DataFrame:
        taken, left = 0, []
        for o, c, v in moves(part):
            if c:
                taken, left = (taken, left[:-1]) if left else (taken + 1, left)
            if o:
                left.append(v)
        return pd.DataFrame([(part[key].iloc[0], part["__block"].iloc[0], taken, left)], columns=[key, "__block", "taken", "left"])

    def starts(part: pd.DataFrame) -> pd.DataFrame:
        out, stack = [], []
        for b, taken, left in part.sort_values("__block")[["__block", "taken", "left"]].itertuples(index=False):
            out.append((part[key].iloc[0], b, list(stack)))
            stack = stack[: max(0, len(stack) - taken)] + list(left)
        return pd.DataFrame(out, columns=[key, "__block", "__start"])

    def contents(part: pd.DataFrame) -> pd.DataFrame:
        stack, out = list(part["__start"].iloc[0]), []
        for o, c, v in moves(part):
            out.append(list(stack))
            stack = stack[:-1] if c else stack
            stack = [*stack, v] if o else stack
        return part.sort_values(order)[names].assign(stack=out)

    summaries = own.groupBy(key, "__block").applyInPandas(summary, f"`{key}` {kind[key]}, __block long, taken int, left array<{kind[value]}>")
    first = summaries.groupBy(key).applyInPandas(starts, f"`{key}` {kind[key]}, __block long, __start array<{kind[value]}>")
    schema = ", ".join(f"`{c}` {kind[c]}" for c in names) + f", stack array<{kind[value]}>"
    return own.select(*names, "__block").join(first, [key, "__block"]).groupBy(key, "__block").applyInPandas(contents, schema)
