"""The tables of a preprocess run as TSV text: writers, and readers that check headers, counts and identifiers.

Every part file begins with the header. Fields are escaped, so a row is a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import escape_tsv, qid_number, unescape_tsv

# The headers of the three tables.
SOURCES = ["wiki", "surface_key", "surface_text", "qid", "source", "page_id", "target_page_id"]
QIDS = ["surface_key", "qids", "qid_count"]
EDGES = ["qid", "flags", "type_targets", "type_target_count"]


def lines_of(rows: DataFrame, header: list[str]) -> DataFrame:
    """(value) one escaped line a row."""
    return rows.select(F.concat_ws("\t", *[escape_tsv(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in header]).alias("value"))


def source_lines(sources: DataFrame) -> DataFrame:
    return lines_of(sources.orderBy("surface_key", "qid", "wiki", "source", "page_id", "target_page_id"), SOURCES)


def qid_lines(lists: DataFrame) -> DataFrame:
    """Lines of (surface_key, qids) in key order."""
    return lines_of(lists.select("surface_key", F.array_join("qids", "|").alias("qids"), F.size("qids").alias("qid_count")).orderBy("surface_key"), QIDS)


def edge_lines(edges: DataFrame) -> DataFrame:
    """Lines of (qid, flags, targets), by the number of the QID."""
    names = F.array_join(F.transform("targets", lambda t: F.concat(F.lit("Q"), t)), "|")
    rows = edges.orderBy("qid").select(F.concat(F.lit("Q"), "qid").alias("qid"), "flags", names.alias("type_targets"), F.size("targets").alias("type_target_count"))
    return lines_of(rows, EDGES)


def write_lines(lines: DataFrame, path: str, header: list[str]) -> None:
    """The committer publishes a whole folder or none of it."""
    lines.withColumnRenamed("value", "\t".join(header)).write.mode("overwrite").option("header", True).option("sep", "\x00").option("quote", "").option("escape", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)


def read_lines(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """(value) without headers; an error if a file doesn't begin with `header`."""
    lines = spark.read.text(path)
    wanted = "\t".join(header)
    files = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count_if(F.col("value") == wanted).alias("n"))
    if not files.filter("n <> 1").isEmpty():
        raise ValueError(f"unexpected header in {path}")
    return lines.filter(F.col("value") != wanted)


def _require(ok: Column, value: Column, what: str) -> Column:
    """`value` where `ok` holds; otherwise the job fails with the line."""
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(F.col("value"), F.lit("")))))


def _qid(name: Column) -> Column:
    return _require(qid_number(name).isNotNull(), qid_number(name), "not a QID")


def parse_qids(lines: DataFrame) -> DataFrame:
    """(surface_key, qids as numbers, qid_count) of lines; empty keys and wrong identifiers are errors."""
    parts = F.split("value", "\t", 3)
    rows = lines.filter(_require(F.size(parts) == 3, F.lit(True), "too few columns"))
    key = unescape_tsv(parts[0])
    names = F.filter(F.split(unescape_tsv(parts[1]), r"\|"), lambda n: n != "")
    found = rows.select("value", _require(F.length(key) > 0, key, "empty surface_key").alias("surface_key"), F.transform(names, _qid).alias("qids"), parts[2].cast("int").alias("qid_count"))
    return found.select("surface_key", _require(F.size("qids") == F.col("qid_count"), F.col("qids"), "wrong qid_count").alias("qids"), "qid_count")


def parse_edges(lines: DataFrame) -> DataFrame:
    """(qid, flags, targets) of lines; a target may be written property=QID."""
    parts = F.split("value", "\t", 4)
    rows = lines.filter(_require(F.size(parts) == 4, F.lit(True), "too few columns"))
    text = unescape_tsv(parts[2])
    names = F.when(F.length(text) > 0, F.split(text, r"\|")).otherwise(F.array().cast("array<string>"))
    targets = F.transform(names, lambda n: _qid(F.regexp_replace(n, "^[^=]*=", "")))
    found = rows.select("value", _qid(parts[0]).alias("qid"), parts[1].cast("int").alias("flags"), targets.alias("targets"), parts[3].cast("int").alias("n"))
    return found.select("qid", "flags", _require(F.size("targets") == F.col("n"), F.col("targets"), "wrong type_target_count").alias("targets"))


def read_qids(spark: SparkSession, path: str) -> DataFrame:
    return parse_qids(read_lines(spark, path, QIDS))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """A missing table counts as empty."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], "qid long, flags int, targets array<long>")
    return parse_edges(read_lines(spark, path, EDGES))
