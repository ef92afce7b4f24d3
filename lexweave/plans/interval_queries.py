"""Queries over intervals: the spans of days that suppliers are at work on their lines, as far as they overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import intervals
from lexweave.plans.registry import query
from lexweave.session import table
from lexweave.staging import stage


def _spans(spark, d):
    """One interval for each supplier, first day and length, ranked by the least part number."""
    start, days = F.unix_date(F.to_date("l_shipdate")).cast("bigint"), F.col("l_quantity").cast("bigint")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), start.alias("start"), days.alias("days"), "l_partkey")
    rows = rows.groupBy("key", "start", "days").agg(F.min("l_partkey").alias("rank"))
    return rows.select("key", ((F.col("key") * 100_000 + F.col("start")) * 100 + F.col("days")).alias("id"), "start", (F.col("start") + F.col("days")).alias("end"), "rank")


SPANS_SQL = """spans AS (
  SELECT key, (key * 100000 + first_day) * 100 + days AS id, first_day, first_day + days AS last_day, min(l_partkey) AS rank
  FROM (SELECT l_suppkey AS key, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS first_day, l_quantity::BIGINT AS days, l_partkey FROM lineitem) GROUP BY key, first_day, days
)"""


@query(f"""WITH {SPANS_SQL} SELECT a.id, count(*) AS n_overlaps, min(b.id) AS least, max(b.id) AS greatest
FROM spans a JOIN spans b ON a.key = b.key AND a.id <> b.id AND a.first_day < b.last_day AND b.first_day < a.last_day GROUP BY a.id""")
def interval_overlaps(spark, d):
    spans = stage(_spans(spark, d), "spans")  # both sides of both joins read them
    pairs = intervals.overlaps(spans, spans).filter("left_id <> right_id")
    return pairs.groupBy(F.col("left_id").alias("id")).agg(F.count(F.lit(1)).alias("n_overlaps"), F.min("right_id").alias("least"), F.max("right_id").alias("greatest"))


@query(f"""WITH RECURSIVE {SPANS_SQL}, turns AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, id) AS turn FROM spans
), steps AS (
  SELECT key, turn, id, true AS takes, [[first_day, last_day]] AS taken FROM turns WHERE turn = 1
  UNION ALL
  SELECT key, turn, id, free, CASE WHEN free THEN list_append(taken, [first_day, last_day]) ELSE taken END FROM (
    SELECT t.key, t.turn, t.id, t.first_day, t.last_day, s.taken, len(list_filter(s.taken, lambda x: x[1] < t.last_day AND t.first_day < x[2])) = 0 AS free
    FROM steps s JOIN turns t ON t.key = s.key AND t.turn = s.turn + 1)
) SELECT key, id, first_day, last_day FROM steps JOIN spans USING (key, id) WHERE takes""")
def interval_choice(spark, d):
    """The spans that a greedy choice by rank takes, so that no two of a supplier overlap."""
    return intervals.disjoint(_spans(spark, d)).select("key", "id", F.col("start").alias("first_day"), F.col("end").alias("last_day"))
