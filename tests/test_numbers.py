"""Numbers of rows in groups larger than a task."""

from __future__ import annotations

import re

from quillspark.operators import phases as H


def test_numbers_over_ranges(spark):
    rows = [("big", k % 7, f"i{k}") for k in range(400)] + [(g, k, f"i{g}{k}") for g in ("a", None, "zz") for k in (2, 1)]
    df = spark.createDataFrame(rows, "path string, line int, id string")
    want = {}
    for g in ("big", "a", None, "zz"):
        want |= {r[2]: n for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1)}
    for most in (50, 10_000):
        out = H.numbered(df, "path", ["line", "id"], most)
        assert out.count() == len(rows) and {r.id: r.number for r in out.collect()} == want and out.columns == ["path", "line", "id", "number"]


def test_no_task_numbers_a_large_group(spark):
    df = spark.range(2000).selectExpr("'f' AS path", "id")
    plan = H.numbered(df, "path", ["id"], 100)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"row_number\(\) windowspecdefinition\(path#\d+, __part#", plan) and not re.search(r"row_number\(\) windowspecdefinition\(path#\d+, id", plan)
