"""Hints with free ranges, many groups at a time."""

from __future__ import annotations

import time

from quillspark.operators import lexicon as L

RANGES = "array<struct<text_id: int, start: int, end: int>>"


def test_choice_of_ties_and_nulls(spark):
    rows = [
        ("a", "xy", 1, 5, [(1, 0, 2)]), ("a", "zw", 1, 9, [(1, 1, 3)]), ("a", "long", None, 99, [(1, 5, 6)]), ("a", "v", 1, 1, [(1, 4, 5), (2, 0, 1)]), ("a", "u", 1, 1, [(2, 0, 1)]),
        ("b", "q", 1, 1, []), (None, "r", 1, 1, [(1, 0, 1)]),
    ]
    df = spark.createDataFrame(rows, f"g string, source string, priority int, score int, ranges {RANGES}")
    got = sorted(map(tuple, L.free_range_choice(df, "g").collect()), key=str)
    # of equal length the better score, then the lesser name; no range is none that is free, what has no priority is last
    assert got == sorted([("a", "zw"), ("a", "u"), ("a", "v"), ("a", "long"), (None, "r")], key=str)


def test_many_small_groups(spark):
    """A call for each of forty thousand groups takes minutes."""
    df = spark.range(40_000, numPartitions=4).selectExpr("id AS g", "'s' AS source", "1 AS priority", "1 AS score", f"CAST(array(struct(1, 0, 3)) AS {RANGES}) AS ranges")
    began = time.time()
    assert L.free_range_choice(df, "g").count() == 40_000
    assert time.time() - began < 25
