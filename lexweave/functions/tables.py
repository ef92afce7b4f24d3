"""Table functions for Spark SQL text, used with LATERAL joins.

    SELECT p.* FROM lines, LATERAL dump_rows(value, 'page_id BIGINT, namespace INT, title STRING') AS p
    SELECT n.note_id, p.* FROM notes AS n, LATERAL markdown_pieces(n.text, 'wiki') AS p

They yield rows as they are found, so that no line or note is held as an array of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DataType, DoubleType, IntegerType, LongType, StringType, StructType

from lexweave.functions.markdown import pieces
from lexweave.session import ship
from lexweave.sources.dumps import parse_tuples

TYPES: dict[str, tuple[DataType, type]] = {"STRING": (StringType(), str), "INT": (IntegerType(), int), "BIGINT": (LongType(), int), "DOUBLE": (DoubleType(), float)}


def _columns(spec: str) -> list[tuple[str, str]]:
    """Names and types of a list of columns."""
    found = [tuple(part.split()) for part in spec.split(",")]
    for column in found:
        if len(column) != 2 or column[1].upper() not in TYPES:
            raise ValueError(f"not a column of type {', '.join(TYPES)}: {' '.join(column)}")
    return [(name, kind.upper()) for name, kind in found]


class DumpRows:
    """Tuples of an INSERT line, with the columns that the second argument names; tuples of fewer fields are left out.

    A null line has none. A field that is empty or doesn't read as its type is null, unless that is a string.
    """

    @staticmethod
    def analyze(line: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(columns.value, str):
            raise ValueError("dump_rows() needs its columns as a constant text")
        schema = StructType()
        for name, kind in _columns(columns.value):
            schema = schema.add(name, TYPES[kind][0])
        return AnalyzeResult(schema)

    def eval(self, line: str | None, columns: str) -> Iterator[tuple]:
        kinds = [TYPES[kind][1] for _, kind in _columns(columns)]
        for fields in parse_tuples(line) if line else ():
            if len(fields) >= len(kinds):
                yield tuple(self.read(kind, field) for kind, field in zip(kinds, fields))

    @staticmethod
    def read(kind: type, field: str) -> object:
        try:
            return kind(field)
        except ValueError:
            return None


class MarkdownPieces:
    """The pieces of a Markdown note, in order; a null note has none."""

    def eval(self, text: str | None, folder: str) -> Iterator[tuple]:
        for n, p in enumerate(pieces(text or "", folder)):
            yield (n, *p)


def register(spark: SparkSession) -> None:
    """Make dump_rows() and markdown_pieces() known to the session's SQL."""
    ship(spark)
    spark.udtf.register("dump_rows", udtf(DumpRows))
    spark.udtf.register("markdown_pieces", udtf(MarkdownPieces, returnType="piece_no int, syntax string, text string, start int, end int, eid string, path string"))
