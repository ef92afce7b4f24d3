"""Counts that a run reports about its tables; each is one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _n(condition) -> F.Column:
    return F.count_if(condition).cast("bigint")


class Watch:
    """Counts that are taken while rows are written, by phase: rows, the greatest id, and what else is asked for.

    A watched table should be written once, without a limit behind it; its numbers are there as soon as that has ended.
    """

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def __call__(self, rows: DataFrame, phase: str, last_id: str | Column | None, **more: Column) -> DataFrame:
        self.seen[phase] = Observation()
        found = {"rows": F.count(F.lit(1))} | ({} if last_id is None else {"last_id": F.max(last_id)}) | more
        return rows.observe(self.seen[phase], *[c.alias(name) for name, c in found.items()])

    def phases(self) -> dict[str, dict]:
        """By phase its numbers, in the order in which they were watched."""
        return {phase: dict(found.get) for phase, found in self.seen.items()}


def preprocess_summary(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(wiki, pages, with_qid, redirects, sources) a wiki."""
    seen = pages.groupBy("wiki").agg(F.count(F.lit(1)).alias("pages"), F.count("qid").alias("with_qid"))
    made = sources.groupBy("wiki").agg(_n(F.col("source") == "redirect").alias("redirects"), F.count(F.lit(1)).alias("sources"))
    return seen.join(made, "wiki", "full").na.fill(0)


def scan_statistics(claims: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of scanned entities (qid, flags, targets): handled, candidates among them, retained, with targets, targets, disambiguation pages."""
    marked = claims.join(candidates.select("qid").distinct().withColumn("hit", F.lit(True)), "qid", "left")
    hit, some = F.coalesce("hit", F.lit(False)), F.size("targets") > 0
    flagged = F.col("flags").bitwiseAND(1) != 0
    return marked.agg(F.count(F.lit(1)).alias("handled"), _n(hit).alias("candidate_hits"), _n(hit | (F.col("flags") != 0) | some).alias("retained"), _n(some).alias("with_targets"), F.coalesce(F.sum(F.size("targets")), F.lit(0)).cast("bigint").alias("targets"), _n(flagged).alias("disambiguations"))


def runtime_statistics(lists: DataFrame) -> DataFrame:
    """Of (surface_key, qids as numbers): surfaces, listed QIDs, distinct QIDs and the largest."""
    one = lists.select("surface_key", F.explode_outer("qids").alias("qid"))
    return one.agg(F.count_distinct("surface_key").alias("surfaces"), F.count("qid").alias("listed"), F.count_distinct("qid").alias("eids"), F.max("qid").alias("max_qid"))


def pattern_statistics(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    return patterns.agg(F.count(F.lit(1)).alias("patterns"), F.coalesce(F.sum(F.octet_length(pattern)), F.lit(0)).cast("bigint").alias("bytes"))


def sync_counts(mentions: DataFrame, conflicts: DataFrame, matches: DataFrame) -> DataFrame:
    """(note_id, mentions, conflicts, conflict_matches) a note that has any of them."""
    named = [rows.groupBy("note_id").agg(F.count(F.lit(1)).alias(name)) for name, rows in (("mentions", mentions), ("conflicts", conflicts), ("conflict_matches", matches))]
    return named[0].join(named[1], "note_id", "full").join(named[2], "note_id", "full").na.fill(0)
