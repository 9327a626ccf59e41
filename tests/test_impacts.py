"""Impacts of items against pairs counted one by one."""

from __future__ import annotations

import random

from quillspark.operators import references as R

ALIASED = {"BASE": ["BASE", "MAXBASE"], "MAXBASE": ["MAXBASE", "DOWNBASE"], "EX": ["EX", "NOWEX"]}
LADDER = ["unresolved", "ambiguous", "indirect", "direct"]


def by_pairs(items, references):
    rows = {}
    for i, space, keys in items:
        named = {(s, k) for s in ALIASED.get(space, [space]) for k in keys}
        rows.setdefault(i, set()).update((r, kind) for r, s, key, more, kind in references for k in (key, *(more or ())) if k is not None and k.strip() and (s, k) in named)
    status = lambda kinds: next((k for k in LADDER if k in kinds), "none")
    return sorted((i, len(rows[i]), status({k for _, k in rows[i]})) for i, *_ in items)


def test_impacts_of_repeated_ids(spark):
    draw = random.Random(4)
    spaces, keys = ["BASE", "MAXBASE", "DOWNBASE", "EX", "NOWEX", "ITEM"], ["a", "b", "c", "1", " "]
    items = [(n % 30, draw.choice(spaces), draw.sample(keys, 2)) for n in range(36)]
    references = [(draw.randrange(60), draw.choice(spaces), draw.choice([*keys, None]), draw.choice([None, [], ["a", "c"], ["b", None]]), draw.choice(LADDER[1:])) for _ in range(90)]
    a = spark.createDataFrame(items, "item_id long, namespace string, keys array<string>")
    b = spark.createDataFrame(references, "reference_id long, namespace string, key string, candidates array<string>, kind string")
    assert sorted(map(tuple, R.reference_impact(a, b, ALIASED).collect())) == by_pairs(items, references)


def test_impacts_without_pairs(spark):
    """A hundred thousand items and as many references of one key are no ten thousand million pairs."""
    items = spark.range(100_000).selectExpr("id AS item_id", "'ITEM' AS namespace", "array('a', 'b') AS keys")
    references = spark.range(100_000).selectExpr("id AS reference_id", "'ITEM' AS namespace", "'a' AS key", "array('b') AS candidates", "'direct' AS kind")
    got = R.reference_impact(items, references).groupBy("impact", "status").count().collect()
    assert [tuple(r) for r in got] == [(100_000, "direct", 100_000)]


def test_alias_groups():
    own = R.alias_groups({"A": ["B"], "C": ["D"], "D": ["B"]})
    assert own == dict.fromkeys("ABCD", "A")
