"""Which entities to report: vetoes and a signed score over distance cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Anchor QIDs by anchor id (0 to 14 speak for an entity, 15 to 26 against it).
ANCHOR_QIDS = [5, 11862829, 1047113, 4671286, 23847174, 33104279, 1387659, 1969448, 12812139, 179461, 732577, 47461344, 7725634, 43229, 3918, 4167410, 82042, 2374489, 11953984, 48937186, 3695082, 80071, 21146257, 16889133, 133449656, 108586636, 116505632]
# Signed weights by anchor id; anchors 15, 16, 17 and 21 only veto.
WEIGHTS = {0: 1, 1: 4, 2: 4, 3: 5, 4: 5, 5: 6, 6: 5, 7: 1, 8: 3, 9: 6, 10: 2, 11: 1, 12: 4, 13: 2, 14: 5, 18: -4, 19: -5, 20: -4, 22: -3, 23: -3, 24: -3, 25: -3, 26: -3}
VETOES, VETO_DISTANCE = [15, 16, 17, 21], 2


def anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ANCHOR_QIDS)), "anchor_id int, qid long")


def distance_weight(distance: Column) -> Column:
    return F.when(distance == 0, 1.5).when(distance <= 1, 1.0).when(distance <= 2, 0.7).when(distance <= 4, 0.35).otherwise(0.15)


def color_score(color: Column) -> Column:
    """Weight times distance weight; 0 for anchors without a weight."""
    weights = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(weights, color["anchor_id"]), F.lit(0)).cast("double") * distance_weight(color["distance"])


def survival_score(colors: Column) -> Column:
    """A left fold in card order: the rounding of doubles is part of the result."""
    return F.aggregate(colors, F.lit(0.0), lambda total, c: total + color_score(c))


def should_report(flags: Column, colors: Column) -> Column:
    veto = F.exists(colors, lambda c: c["anchor_id"].isin(VETOES) & (c["distance"] <= VETO_DISTANCE))
    return (flags.bitwiseAND(1) == 0) & ~veto & (survival_score(colors) > 0)


def filter_candidates(surfaces: DataFrame, policy: DataFrame) -> DataFrame:
    """(surface_key, qids): candidate lists without unreported entities, and without surfaces left empty."""
    one = surfaces.select("surface_key", F.explode("qids").alias("qid")).join(policy.filter("report").hint("merge"), "qid", "left_semi")
    return one.groupBy("surface_key").agg(F.array_sort(F.collect_list("qid")).alias("qids"))
