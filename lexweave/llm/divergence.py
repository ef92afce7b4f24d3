"""How far sources of a language differ in their terms, counted by DuckDB in shards and merged by Spark.

Three passes. Each partition counts its terms with DuckDB (lower-cased A-Z, occurrences, and documents that
have them) and sends one row a language, source and term. Shards by a hash of language and term add these up
and keep terms of enough documents. After Spark has summed the sizes of all groups, shards of the kept terms
compute rates in 128-bit integers and emit partial sums: for pairs of sources that share a term, of how
many terms a source has at which rate, and the leading terms of each source. Spark merges sums and rankings.

The distance of two sources, the sum over kept terms of |p - q|, is taken apart so that a shard only joins
sources that both have a term: with rest rates p0, q0 of absent terms it is V |p0 - q0|, plus
|p - q0| - |p0 - q0| for each term of the first source and |q - p0| - |p0 - q0| for each of the second, plus
what corrects this where both have the term. The two sums over one source's terms come from its rates'
cumulative counts. Only the result itself has a row for every pair of sources of a language.

Defined results: a null text, language or source is an empty string, and an empty string is a language or
source like any other. A group without terms has pairs like any other; a language without kept terms has
pairs of value 0. Repeated rows are documents of their own. An empty table gives an empty result. Columns
other than the three are not read.
"""

from __future__ import annotations

import shutil
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from tempfile import mkdtemp

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import ship
from lexweave.staging import stage

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, ADDED = 1_000_000_000, 5
BYTES_AT_ONCE, ROWS_HELD, ROWS_OUT = 8_000_000, 1_000_000, 50_000

COUNT_SQL = """
INSERT INTO held
SELECT lang, source, term, sum(n), count(*) FROM (
  SELECT lang, source, doc, term, count(*) AS n FROM (
    SELECT lang, source, doc, unnest(regexp_extract_all(text, '{term}')) AS term FROM texts
  ) GROUP BY ALL
) GROUP BY ALL
UNION ALL SELECT DISTINCT lang, source, '', 0, 0 FROM texts
"""

MERGE_SQL = """
CREATE TEMP TABLE held AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(d)::BIGINT AS d FROM rows GROUP BY ALL;
CREATE TEMP TABLE kept AS SELECT lang, term, sum(n)::BIGINT AS lang_n, min(source) AS leader FROM held GROUP BY ALL HAVING sum(d) >= {min_docs};
SELECT lang, source, term, n, lang_n, (source = leader)::BIGINT AS leads FROM held JOIN kept USING (lang, term)
UNION ALL SELECT lang, source, '', 0, 0, 0 FROM held WHERE term = ''
"""

PAIR_SQL = """
CREATE TEMP TABLE rates AS
SELECT lang, source, term, rest,
       (1 + ({scale}::HUGEINT * (n + {added})) // (size::HUGEINT + {added} * terms))::BIGINT AS p,
       (1 + ({scale}::HUGEINT * (lang_n + {added})) // (lang_size::HUGEINT + {added} * terms))::BIGINT AS q
FROM rows;
SELECT 'both' AS kind, a.lang, a.source, b.source AS item,
       sum(abs(a.p - b.p) - abs(a.p - b.rest) - abs(a.rest - b.p) + abs(a.rest - b.rest))::BIGINT AS value, 0::BIGINT AS n
FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
UNION ALL
SELECT 'rate', lang, source, NULL, p, count(*) FROM rates GROUP BY ALL
UNION ALL
SELECT 'term', lang, source, term, p - q, 0 FROM rates WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {top}
"""


@contextmanager
def _duck():
    """DuckDB for one task: one thread, bounded memory, and a folder of its own for what goes beyond."""
    import duckdb

    folder = mkdtemp(prefix="lexweave-duck-")
    con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": folder, "preserve_insertion_order": False})
    try:
        yield con
    finally:
        con.close()
        shutil.rmtree(folder, ignore_errors=True)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of a bounded number of bytes, one text at least, with a number for each document."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.binary_length(batch.column("text")).cast(pa.int64())).to_pylist()
        begin = 0
        while begin < len(ends):
            end, before = begin + 1, ends[begin - 1] if begin else 0
            while end < len(ends) and ends[end] - before <= BYTES_AT_ONCE:
                end += 1
            part = batch.slice(begin, end - begin)
            yield pa.table({"lang": part.column("lang"), "source": part.column("source"), "text": pc.ascii_lower(part.column("text")), "doc": pa.array(range(len(part)), pa.int64())})
            begin = end


def _in_order(con, schema: pa.Schema, batches: Iterable[pa.RecordBatch], sql: str) -> Iterator[pa.RecordBatch]:
    """The last statement's rows; the first one reads `rows`, the batches as they come."""
    rows = pa.RecordBatchReader.from_batches(schema, batches)
    con.register("rows", rows)
    *first, last = sql.split(";\n")
    for statement in first:
        con.sql(statement)
    yield from con.sql(last).to_arrow_reader(ROWS_OUT)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with _duck() as con:
        con.sql("CREATE TEMP TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, d BIGINT)")

        def sums():
            yield from con.sql("SELECT lang, source, term, sum(n)::BIGINT AS n, sum(d)::BIGINT AS d FROM held GROUP BY ALL").to_arrow_reader(ROWS_OUT)
            con.sql("TRUNCATE held")

        for texts in _slices(batches):
            con.register("texts", texts)
            con.sql(COUNT_SQL.format(term=TERM))
            con.unregister("texts")
            if con.sql("SELECT count(*) FROM held").fetchall()[0][0] >= ROWS_HELD:
                yield from sums()
        yield from sums()


def _shards(rows: DataFrame, sql: str, schema: str) -> DataFrame:
    """Run `sql` over each shard of `rows`; all rows of a language's term are in one shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            with _duck() as con:
                yield from _in_order(con, first.schema, (b for some in ((first,), batches) for b in some), sql)

    return rows.repartition("lang", "term").mapInArrow(run, schema)


def _pair_values(parts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item and the sum of |p - q| over all kept terms, for each ordered pair of sources."""
    mine = groups.select("lang", "source", "terms", F.col("rest").alias("p0"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("rest").alias("q0"))
    pairs = mine.join(others, "lang").filter("source <> item")
    base = pairs.select("lang", "source", "item", F.coalesce(F.col("terms") * F.abs(F.col("p0") - F.col("q0")), F.lit(0)).alias("value"))
    both = parts.filter("kind = 'both'").select("lang", "source", "item", "value")

    rates = parts.filter("kind = 'rate'").groupBy("lang", "source", F.col("value").alias("p")).agg(F.sum("n").alias("n"))
    points = rates.select("lang", "source", "p", "n", F.lit(None).cast("string").alias("item"), F.lit(None).cast("bigint").alias("p0"))
    asked = pairs.filter("terms > 0").select("lang", "source", F.col("q0").alias("p"), F.lit(0).cast("bigint").alias("n"), "item", "p0")
    group = Window.partitionBy("lang", "source")
    upto = group.orderBy("p", F.col("item").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    known = points.unionByName(asked).select("lang", "source", "item", "p", "p0", *[
        F.sum(c).over(w).alias(name) for name, c, w in (("low_n", F.col("n"), upto), ("low_p", F.col("n") * F.col("p"), upto), ("all_n", F.col("n"), group), ("all_p", F.col("n") * F.col("p"), group))
    ]).filter(F.col("item").isNotNull())
    q0 = F.col("p")
    gaps = q0 * F.col("low_n") - F.col("low_p") + F.col("all_p") - F.col("low_p") - q0 * (F.col("all_n") - F.col("low_n"))
    alone = known.select("lang", "source", "item", (gaps - F.col("all_n") * F.abs(F.col("p0") - q0)).alias("value"))

    turned = [x.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value") for x in (both, alone)]
    parted = base.unionByName(both).unionByName(alone).unionByName(turned[0]).unionByName(turned[1])
    return parted.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank: distances to the language's other sources, and leading terms.

    Terms are kept in a language by `min_docs` documents at least; rates are 1 + floor(10^9 (count + 5) / (size + 5 terms)).
    """
    ship(docs.sparkSession)
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = named.mapInArrow(_count, "lang string, source string, term string, n long, d long")
    kept = stage(_shards(counted, MERGE_SQL.format(min_docs=int(min_docs)), "lang string, source string, term string, n long, lang_n long, leads long"), "kept-terms")

    sizes = stage(kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum("leads").alias("leads")), "group-sizes")
    langs = sizes.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.sum("leads").alias("terms"))
    rest = F.expr(f"CASE WHEN terms > 0 THEN 1 + {SCALE * ADDED} div (size + {ADDED} * terms) END")
    groups = stage(sizes.drop("leads").join(langs, "lang").withColumn("rest", rest), "group-rates")

    rated = kept.filter("term <> ''").drop("leads").join(groups, ["lang", "source"])
    sql = PAIR_SQL.format(scale=SCALE, added=ADDED, top=int(top))
    parts = stage(_shards(rated, sql, "kind string, lang string, source string, item string, value long, n long"), "partial-sums")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pair_values(parts, groups).withColumn("rank", F.row_number().over(ranked))
    terms = parts.filter("kind = 'term'").select("lang", "source", "item", "value", F.row_number().over(ranked).alias("rank")).filter(F.col("rank") <= top)
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
