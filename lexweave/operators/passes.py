"""Repeated passes over notes: match, rewrite, and again, until a note no longer changes or has had its passes.

What a rewritten note says may match otherwise than before, so mentions and conflicts are those of the last text
that was matched. Only notes that a pass has changed go on to the next one; each pass is staged.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators import notes as N
from lexweave.operators.store import inherit_decisions
from lexweave.staging import stage


@dataclass(frozen=True)
class Settled:
    """texts: note_id, text, changed, passes; groups: the clusters of N.mention_groups() of each note's last pass; sizes: notes in each pass."""

    texts: DataFrame
    groups: DataFrame
    sizes: list[int]


def decided(groups: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Matches of conflicts, with decisions of `stored` (see inherit_decisions) where a link has made none."""
    matches = N.conflict_matches_of(N.conflicts_of(groups))
    return matches if stored is None else inherit_decisions(matches, stored)


def settle(notes: DataFrame, patterns: list[str], candidates: DataFrame, entities: DataFrame | None = None, stored: DataFrame | None = None, folder: str = "wiki", more: int = 3) -> Settled:
    """One pass over (note_id, text), and up to `more` over notes that the one before has changed.

    A null text stays null after one pass. Rows of one note_id should be one.
    """
    live = stage(notes.select("note_id", "text"), "pass-notes")
    texts, groups, sizes = [], [], []
    for k in range(1, more + 2):
        found = stage(N.note_groups(live, patterns, candidates, entities, folder=folder), "pass-groups")
        wanted = N.replacements(N.mentions_of(found), decided(found, stored), folder)
        now = stage(N.render_notes(live, wanted, folder=folder).withColumn("changed", F.coalesce("changed", F.lit(False))), "pass-texts")
        ends = F.lit(True) if k == more + 1 else ~F.col("changed")
        done = now.filter(ends)
        texts.append(done.select("note_id", F.col("text").alias("new"), F.lit(k).alias("passes")))
        groups.append(found.join(done.select("note_id"), "note_id", "left_semi"))
        sizes.append(now.count())
        live = now.filter(~ends).select("note_id", "text")
        if live.isEmpty():
            break
    both = notes.select("note_id", F.col("text").alias("old")).join(reduce(DataFrame.unionByName, texts), "note_id")
    return Settled(both.select("note_id", F.col("new").alias("text"), (F.col("new") != F.col("old")).alias("changed"), "passes"), reduce(DataFrame.unionByName, groups), sizes)
