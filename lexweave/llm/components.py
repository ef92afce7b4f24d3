"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al.)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.staging import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (u long, v long); root is the least node of the component.

    A step sends each node's neighbours to the least of them: one partial aggregation and one equi-join, so
    a node with very many neighbours is never gathered in one task. Each round's edges are staged. The
    rounds end when every edge joins a root to a node that has no other edge; the number grows with the
    logarithm of the longest path.
    """
    links = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.filter("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stage(small.union(down.select("u", F.col("m").alias("v"))).distinct(), "links")
        seen = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == before or seen[0] == 0:
            break
        before = seen
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v"), F.col("v")).distinct())
