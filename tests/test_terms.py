"""Terms in texts: what is sent to all tasks."""

from __future__ import annotations

import re

from quillspark.operators import lexicon as L
from tests.test_scale import plan


def test_substrings_are_not_broadcast(spark, tmp_path, monkeypatch):
    """The substrings of a small file of texts are many; the terms are sent to them, or both are dealt."""
    spark.range(3000).selectExpr("id", "concat('ab', id) AS text").write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    terms = spark.createDataFrame([("ab1",), ("b2",), ("zz",)], "term string")
    want = sum(f"ab{k}".startswith("ab1") for k in range(3000)) + sum("b2" in f"ab{k}" for k in range(3000))
    sides = r"BroadcastHashJoin \[term#\d+\], \[term#\d+\], Inner, Build(\w+)"
    out = L.contained_terms(texts, "id", "text", terms, "term", 3)
    assert set(re.findall(sides, plan(out))) == {"Right"} and out.count() == want
    monkeypatch.setattr(L, "BROADCAST", 0)
    out = L.contained_terms(texts, "id", "text", terms, "term", 3)
    assert "Broadcast" not in plan(out) and out.count() == want
