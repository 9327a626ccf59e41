"""Queries against their SQL on rows that the standard tables hold seldom or never."""

from __future__ import annotations

from quillspark.catalog import ORACLE_SQL, QUERIES
from tests.oracle import differences


def test_lines_with_markup_and_blanks(spark, tmp_path):
    text = "12 {Abc} 34\n<b>\n%A%\n薬草\n50%\n-1.5\na／b\n ab \n　　\nab\r\n　ab \n\tab\nx　y\u000bz\na b"
    spark.createDataFrame([(4, text, "en", "src0", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet/part")
    # the oracle reads one file, Spark a folder
    part = next((tmp_path / "documents.parquet" / "part").glob("*.parquet"))
    one = tmp_path / "one"
    one.mkdir()
    part.rename(one / "documents.parquet")
    assert not differences(QUERIES["text_functions"](spark, str(one)), ORACLE_SQL["text_functions"], str(one))
