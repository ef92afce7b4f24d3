"""Table functions in SQL text."""

import pytest
from pyspark.errors import AnalysisException

from lexweave.functions import tables


def test_columns_and_types_come_from_the_arguments(spark):
    tables.register(spark)
    lines = spark.createDataFrame([("INSERT INTO `t` VALUES (1,'a\\'b',NULL),(2,'x','2.5');",), (None,), ("INSERT INTO `t` VALUES (3);",)], "value string")
    got = spark.sql("SELECT p.* FROM {lines}, LATERAL dump_rows(value, 'k BIGINT, s STRING, v DOUBLE') AS p", lines=lines)
    assert got.dtypes == [("k", "bigint"), ("s", "string"), ("v", "double")]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a'b", None), (2, "x", 2.5)]
    assert sorted(r["k"] for r in spark.sql("SELECT p.k FROM {lines}, LATERAL dump_rows(value, 'k INT') AS p", lines=lines).collect()) == [1, 2, 3]
    with pytest.raises(AnalysisException):
        spark.sql("SELECT p.* FROM {lines}, LATERAL dump_rows(value, 'k MAP') AS p", lines=lines).collect()


def test_pieces_join_laterally(spark):
    tables.register(spark)
    notes = spark.createDataFrame([(1, "a `b` [[wiki/Q5|Ask]]"), (2, None), (3, "")], "note_id long, text string")
    got = spark.sql("SELECT n.note_id, p.syntax, p.text, p.eid FROM {notes} AS n, LATERAL markdown_pieces(n.text, 'wiki') AS p ORDER BY n.note_id, p.piece_no", notes=notes)
    assert [tuple(r) for r in got.collect()] == [(1, "text", "a ", None), (1, "inline_code", "`b`", None), (1, "text", " ", None), (1, "link", "Ask", "Q5")]
