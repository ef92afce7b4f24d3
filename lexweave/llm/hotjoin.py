"""Joins whose left side may hold one key very often."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """`left` inner-joined with `right`, one row a key that says in `weight` how many rows of `left` have it.

    Keys that hold more than one in HOT_SHARE of the `total` rows are fewer than HOT_SHARE, whatever the input, and
    are broadcast; rows of other keys are shuffled. `right` should be staged, as it is read twice. A null key matches a null key.
    """
    hot = F.col(weight) * HOT_SHARE > total
    frequent = right.filter(hot).withColumnRenamed(key, "_lw_key")
    rare = right.filter(~hot).withColumnRenamed(key, "_lw_key").hint("merge")
    same = F.col(key).eqNullSafe(F.col("_lw_key"))
    found = left.join(F.broadcast(frequent), same)
    rest = left.join(F.broadcast(frequent.select("_lw_key")), same, "left_anti").join(rare, same)
    return found.unionByName(rest).drop("_lw_key")
