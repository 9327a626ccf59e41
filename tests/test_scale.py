"""Plans that must hold for tables of small files and many rows."""

from __future__ import annotations

from quillspark.operators import references as R
from quillspark.plans.generated import scripts
from quillspark.plans.shared import dealt
from quillspark.sources import segments, symbols
from quillspark.sources.syntax import QUOTED


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scripts_are_dealt_to_tasks(spark):
    rows = spark.range(20_000, numPartitions=1).withColumnRenamed("id", "n")
    parts = scripts(rows, "n", ["X = @n"]).rdd.glom().map(len).collect()
    assert len(parts) == 5 and sum(parts) == 20_000 and max(parts) < 5_000
    assert dealt(rows.limit(100), "n").rdd.getNumPartitions() == 1


def test_files_are_not_broadcast_by_their_size(spark, monkeypatch):
    """Names take up little room in files; as rows of a table sent to every task they would fill the driver."""
    plans = []
    own = R.saved
    monkeypatch.setattr(R, "saved", lambda df, name: plans.append(plan(df)) or own(df, name))
    known = spark.createDataFrame([("F", 1, "DIMS:A"), ("F", 1, "DIMS:B")], "function string, argument int, namespace string")
    calls = spark.createDataFrame([("G", 0, "F", 1), ("H", 2, "G", 0), ("F", 1, "H", 2)], "caller string, parameter int, callee string, argument int")
    got = sorted(map(tuple, R.propagate_keys(known, calls).collect()))
    assert got == [("F", 1, "DIMS:A"), ("G", 0, "DIMS:A"), ("H", 2, "DIMS:A")]
    assert not [p for p in plans if "Broadcast" in p]


def test_steps_of_identifiers_are_worked_out_once(spark):
    """Nested in each other, the steps that blank strings and text out would be repeated for each use of the next one."""
    lines = spark.createDataFrame([("d", 0, 0, "X = 変数 + 処理(1)")], "document_id string, line_number int, start int, code string")
    own = symbols.identifiers(lines)
    assert own._jdf.queryExecution().optimizedPlan().toString().count(QUOTED) <= 4
    assert sorted((r.start, r.name, r.role) for r in own.collect()) == [(4, "変数", "reference"), (9, "処理", "call")]


def test_only_declarations_and_labels_are_looked_up(spark):
    """A join of all lines puts those that declare nothing in one task; the rest is worked on where it is."""
    lines = spark.createDataFrame([("d", 0, 0, '#DIMS 表 = "鍵"'), ("d", 1, 13, "PRINTL 文です。"), ("d", 2, 30, "SELECTCASE 表:0"), ("d", 3, 46, 'CASE "鍵"')], "document_id string, line_number int, start int, code string")
    lookups = spark.createDataFrame([("表",)], "name string")
    own = segments.segments(lines, lookups)
    assert {(r.start, r.text, r.segment_type) for r in own.collect()} == {(11, "鍵", "dims-lookup-key"), (20, "文です。", "print-tail")}
    assert "Union" in own._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
