"""The type graph: reverse adjacency, bounded multi-source search, and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import beside
from lexweave.staging import stage


def reverse_adjacency(edges: DataFrame) -> DataFrame:
    """Distinct (target, source) of edges (source, target)."""
    return edges.select(F.col("target"), F.col("source")).distinct()


def anchor_distances(edges: DataFrame, anchors: DataFrame, depth: int = 6) -> DataFrame:
    """(anchor_id, node, distance): least hops from a node to each anchor along `edges`, `depth` at most.

    One equi-join a hop; known pairs leave the frontier by an anti-join, and each frontier is staged. What grows with
    the graph is never broadcast.
    """
    back = stage(reverse_adjacency(edges), "reverse-edges")
    frontier = stage(anchors.select("anchor_id", F.col("qid").alias("node"), F.lit(0).alias("distance")), "frontier")
    found, n = frontier, frontier.count()
    total = n
    for hop in range(1, depth + 1):
        step = back.join(beside(frontier, n), frontier["node"] == back["target"]).select("anchor_id", F.col("source").alias("node")).distinct()
        step = step.join(beside(found.select("anchor_id", "node"), total), ["anchor_id", "node"], "left_anti")
        frontier = stage(step.withColumn("distance", F.lit(hop)), "frontier")
        n = frontier.count()
        if not n:
            break
        found, total = found.unionByName(frontier), total + n
    return found


def cards(distances: DataFrame, runtime_nodes: DataFrame) -> DataFrame:
    """(node, colors): each runtime node's (anchor_id, distance) pairs in order."""
    kept = distances.join(runtime_nodes.select("node").distinct().hint("merge"), "node", "left_semi")
    return kept.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("anchor_id", "distance"))).alias("colors"))
