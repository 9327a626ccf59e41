"""CSV segments on literal files."""

from __future__ import annotations

from quillspark.sources.tables import csv_segments


def test_csv_segments(spark):
    files = {
        "CSV/Item.csv": ';head\r\n0,薬草,"火,水"\r\n1,key\r\n',
        "CSV/Chara1.csv": "番号,1\n名前, 花子\nCSTR,10,今日は\n素質,勇敢,1\n",
        "CSV/Str.csv": "挨拶,おはよう\nhello,12\n",
        "CSV/GameBase.csv": "コード,作品\n",
        "CSV/VariableSize.csv": "薬,草\n",
        "CSV/_x.csv": "1,薬\n",
    }
    got = csv_segments(spark.createDataFrame(list(files.items()), "document_id string, text string")).orderBy("document_id", "segment_index").collect()
    rows = [(r.document_id[4:], r.line_number, r.field_index, r.text, r.role, r.namespace, r.source_key, r.preserve_whitespace) for r in got]
    assert rows == [
        ("Chara1.csv", 2, 1, "花子", "value", None, "名前", True),
        ("Chara1.csv", 3, 2, "今日は", "value", None, "CSTR/10", True),
        ("Chara1.csv", 4, 1, "勇敢", "key", "TALENT", "素質", False),
        ("GameBase.csv", 1, 1, "作品", "value", None, "コード", False),
        ("Item.csv", 2, 1, "薬草", "value", "ITEM", "0", False),
        ("Item.csv", 2, 2, "火,水", "value", None, "0", False),
        ("Str.csv", 1, 0, "挨拶", "key", "STR", "挨拶", False),
        ("Str.csv", 1, 1, "おはよう", "value", None, "挨拶", False),
        ("Str.csv", 2, 0, "hello", "key", "STR", "hello", False),
        ("_x.csv", 1, 1, "薬", "value", None, "1", False),
    ]
    assert all(files[r.document_id][r.start : r.start + r.length] == r.text for r in got)
