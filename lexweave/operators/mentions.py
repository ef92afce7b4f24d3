"""Clusters of overlapping matches, their classification, contexts and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clusters(matches: DataFrame, note: str | list[str] = "note_id") -> DataFrame:
    """`matches` with cluster_no: a new cluster starts where a match begins at or after all ends before it."""
    order = W.partitionBy(note).orderBy("start", "end", "surface_id")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.coalesce(F.col("start") >= reach, F.lit(True)), 1).otherwise(0)
    flagged = matches.withColumn("_lw_f", fresh)
    return flagged.withColumn("cluster_no", F.sum("_lw_f").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_lw_f")


def classify(clustered: DataFrame, note: str = "note_id") -> DataFrame:
    """One row a cluster: its bounds, matches and kind (mention if one match with one candidate, else conflict)."""
    rows = clustered.groupBy(note, "cluster_no").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_matches"), F.max("n_qids").alias("n_qids"))
    return rows.withColumn("kind", F.when((F.col("n_matches") == 1) & (F.col("n_qids") == 1), "mention").otherwise("conflict"))


def first_links(mentions: DataFrame, note: str = "note_id") -> DataFrame:
    """Only the first mention of each entity in each section of a note."""
    order = W.partitionBy(note, "section", "eid").orderBy("start")
    return mentions.withColumn("_lw_n", F.row_number().over(order)).filter("_lw_n = 1").drop("_lw_n")
