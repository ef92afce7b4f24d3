"""SQL dumps and JSON dumps as tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import qid_number
from lexweave.operators.surfaces import attach_qids
from lexweave.session import ship

ESCAPES = {"0": "\0", "'": "'", '"': '"', "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a", "\\": "\\"}
FIELD = re.compile(r"'((?:[^'\\]|\\.|'')*)'|([^,()']*)", re.S)
ESCAPE = re.compile(r"\\(.)", re.S)
BLANKS = " \t\n\r\f"


def dump_name(wiki: str, date: str, component: str) -> str:
    return f"{wiki}-{date}-{component}.sql.gz"


def dump_path(root: str, wiki: str, date: str, component: str) -> str:
    return f"{root}/{wiki}/{date}/{dump_name(wiki, date, component)}"


def entity_dump_name(date: str) -> str:
    return "latest-all.json.bz2" if date == "latest" else f"wikidata-{date}-all.json.bz2"


def entity_dump_path(root: str, date: str) -> str:
    return f"{root}/wikidatawiki/{date}/{entity_dump_name(date)}"


def check_date(date: str) -> str:
    """`latest` or eight ASCII digits."""
    if date != "latest" and not re.fullmatch("[0-9]{8}", date, re.ASCII):
        raise ValueError(f"not a dump date: {date}")
    return date


def parse_tuples(line: str) -> list[list[str]]:
    """The value tuples of an INSERT statement as text fields; NULL becomes empty, fields are trimmed."""
    at = line.index("VALUES") + 6
    rows: list[list[str]] = []
    while (start := line.find("(", at)) >= 0:
        row, at = [], start + 1
        while True:
            while at < len(line) and line[at] in BLANKS:
                at += 1
            m = FIELD.match(line, at)
            if m[1] is not None:
                value = ESCAPE.sub(lambda e: ESCAPES.get(e[1], e[1]), m[1].replace("''", ""))
            else:
                value = "" if m[2].strip(BLANKS) == "NULL" else m[2]
            row.append(value.strip(BLANKS))
            at = m.end()
            while at < len(line) and line[at] in BLANKS:
                at += 1
            if at >= len(line) or line[at] not in ",)":
                raise ValueError("a tuple is cut off")
            at += 1
            if line[at - 1] == ")":
                break
        rows.append(row)
    return rows


def insert_rows(lines: DataFrame, table: str, limit: int | None = None) -> DataFrame:
    """(fields) a tuple of each line that inserts into `table`; `limit` counts tuples before any filter."""
    ship(lines.sparkSession)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"fields": [row for line in batch["value"] for row in parse_tuples(line)]})

    rows = lines.filter(F.col("value").startswith(f"INSERT INTO `{table}` ")).select("value").mapInPandas(parse, "fields array<string>")
    return rows.limit(limit) if limit is not None else rows


def read_dump(spark: SparkSession, path: str, table: str, limit: int | None = None) -> DataFrame:
    """Bad bytes become U+FFFD; gz is read transparently."""
    return insert_rows(spark.read.text(path), table, limit)


def pages(rows: DataFrame) -> DataFrame:
    f = F.col("fields")
    return rows.filter((F.size(f) >= 4) & (f[1] == "0")).select(f[0].cast("bigint").alias("page_id"), f[1].cast("int").alias("namespace"), f[2].alias("title"))


def page_props(rows: DataFrame) -> DataFrame:
    """(page_id, propname, value, seq) of the rows that name a page's entity; seq rises along the file."""
    f = F.col("fields")
    found = rows.withColumn("seq", F.monotonically_increasing_id()).filter((F.size(f) >= 3) & (f[1] == "wikibase_item"))
    return found.select(f[0].cast("bigint").alias("page_id"), f[1].alias("propname"), f[2].alias("value"), "seq")


def redirects(rows: DataFrame) -> DataFrame:
    f = F.col("fields")
    return rows.filter((F.size(f) >= 3) & (f[1] == "0")).select(f[0].cast("bigint").alias("source_page_id"), f[1].cast("int").alias("namespace"), f[2].alias("target_title"))


def wiki_tables(spark: SparkSession, root: str, wikis: list[str], date: str, limit: int | None = None, watch: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages with their QIDs, and redirects, of all `wikis`; a missing dump is an error. `watch` may attach observations to a wiki's pages."""
    found = []
    for wiki in wikis:
        read = lambda component: read_dump(spark, dump_path(root, wiki, check_date(date), component), component, limit)  # noqa: B023, E731
        named = pages(read("page")).withColumn("wiki", F.lit(wiki))
        named = attach_qids(named, page_props(read("page_props")))
        found.append((watch(named, wiki) if watch else named, redirects(read("redirect")).withColumn("wiki", F.lit(wiki))))
    joined = [reduce(DataFrame.unionByName, side) for side in zip(*found, strict=True)]
    return joined[0], joined[1]


CLAIMS = "struct<id:string,claims:struct<P31:array<struct<mainsnak:struct<datavalue:struct<value:struct<id:string>>>>>,P279:array<struct<mainsnak:struct<datavalue:struct<value:struct<id:string>>>>>>>"


def entity_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a JSON dump, plain or compressed."""
    return spark.read.text(path)


def entity_claims(lines: DataFrame) -> DataFrame:
    """(qid, targets) of a JSON dump in array-of-lines form; only classes and kinds are read."""
    text = F.regexp_replace(F.btrim("value", F.lit(" \t\r\n")), ",$", "")
    # a generator, and a variable for the text, so that each line is parsed once however often its fields are read
    parsed = F.transform(F.array(text), lambda j: F.when(~j.isin("", "[", "]"), F.from_json(j, CLAIMS, {"mode": "FAILFAST"})))
    rows = lines.select(F.explode(parsed).alias("e")).filter(F.col("e").isNotNull())
    ids = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: x["mainsnak"]["datavalue"]["value"]["id"])
    found = rows.select(F.col("e.id").alias("qid"), F.concat(ids(F.col("e.claims.P31")), ids(F.col("e.claims.P279"))).alias("targets"))
    return found.filter(qid_number(F.col("qid")).isNotNull())
