"""Sync of a folder of notes: changed files are matched and rewritten until they settle, and the store gets one new version.

Files whose modification time or hash is that of the store are left alone. Decisions that the store has of conflicts
with the same surroundings are taken over. Rewritten notes and missing entity notes are written as tables
(path, text); whoever owns the files puts them in place.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import matching, notes, passes, snapshots, store
from lexweave.operators.policy import filter_candidates
from lexweave.operators.surfaces import dense_ids
from lexweave.sources import vault
from lexweave.staging import stage


def _observed(base: snapshots.Snapshot, files: DataFrame, now: int) -> DataFrame:
    """The rows of notes after a look at `files` (path, mtime, size, hash), with `text` where a file is new or modified."""
    known = store.ensure_notes(base.table("notes"), files, now)
    old = base.table("notes").select("note_id", *[F.col(c).alias(f"old_{c}") for c in ("mtime", "size", "hash", "seen_scan")])
    seen = files.select("path", "text", *[F.col(c).alias(f"new_{c}") for c in ("mtime", "size", "hash")])
    both = known.join(old, "note_id", "left").join(seen, "path", "left")
    there = F.col("new_hash").isNotNull()
    same = there & (F.coalesce(F.col("old_mtime") == F.col("new_mtime"), F.lit(False)) | F.coalesce(F.col("old_hash") == F.col("new_hash"), F.lit(False)))
    pick = {c: F.coalesce(f"new_{c}", f"old_{c}").alias(c) for c in ("mtime", "size", "hash")}
    return both.select(
        "note_id", "path", F.when(~there, "missing").when(same, F.col("status")).otherwise("modified").alias("status"), there.alias("view_exists"), *pick.values(),
        F.when(there, F.lit(now)).otherwise(F.col("old_seen_scan")).alias("seen_scan"), F.lit(now).alias("scanned_at"), "created_at", "updated_at", F.when(there & ~same, F.col("text")).alias("text"), (there & ~same).alias("due"),
    )


def sync_folder(spark: SparkSession, surfaces: DataFrame, report: DataFrame | None, root: str, store_root: str, out: str, entity_dir: str = "wiki", lang: str = "zh") -> snapshots.Snapshot:
    """Sync the notes below `root` by candidate lists (surface_key, qids as numbers) and the policy's `report`; the new version.

    Writes `out`/notes (path, text, changed, passes) for the notes that were due, and `out`/entity_views (path, text).
    """
    now = int(time.time() * 1000)
    base = snapshots.latest(spark, store_root) if snapshots.exists(spark, store_root) else snapshots.create(spark, store_root)
    rows = stage(_observed(base, vault.note_files(spark, root, entity_dir), now), "observed-notes")
    due = rows.filter("due").select("note_id", "text")

    kept = filter_candidates(surfaces, report) if report is not None else surfaces.filter(F.size("qids") > 0).select("surface_key", "qids")
    kept = stage(dense_ids(kept, "surface_key", "surface_id"), "surfaces")
    words = matching.collect_patterns(kept.select("surface_id", F.col("surface_key").alias("pattern")))
    candidates = kept.select(F.col("surface_id").cast("int").alias("surface_id"), F.transform("qids", lambda q: F.concat(F.lit("Q"), q.cast("string"))).alias("eids"))
    told = store.stored_resolutions(base.table("conflicts"), base.table("conflict_matches").drop("note_id")).select("hash", "surface", "surface_id", F.col("source_start").alias("start"), F.col("source_end").alias("end"), "resolved_eid", F.col("conflict_id").alias("seq"))
    settled = passes.settle(due, words, candidates, stored=stage(told, "decisions"), folder=entity_dir)
    texts, groups = stage(settled.texts, "settled-texts"), stage(settled.groups, "settled-groups")

    mentions = notes.mentions_of(groups).select("note_id", F.lit(None).cast("bigint").alias("entity_id"), "eid", "text", "surface_id", "source_start", "source_end", "suspect", "resolved")
    number = F.xxhash64("note_id", "segment_no", "cluster_no")
    conflicts = notes.conflicts_of(groups).withColumn("conflict_id", number)
    matches = passes.decided(groups, told).withColumn("conflict_id", number)
    matches = stage(matches.select("note_id", "conflict_id", "resolved_eid", "surface", "surface_id", F.col("start").alias("source_start"), F.col("end").alias("source_end"), "eids"), "conflict-matches")
    conflicts = conflicts.select(*[c.split()[0] for c in store.TABLES["conflicts"].split(", ")])

    named = mentions.filter(store.effective(F.col("suspect"), F.col("resolved"))).select("eid").unionByName(matches.filter(F.col("resolved_eid").isNotNull()).select(F.col("resolved_eid").alias("eid"))).distinct()
    have = base.table("entities")
    top = have.agg(F.coalesce(F.max("entity_id"), F.lit(0)).alias("top"))  # one row
    fresh = dense_ids(named.join(have.select("eid"), "eid", "left_anti"), "eid", "n").join(F.broadcast(top))
    path = F.concat(F.lit(f"{entity_dir}/" if entity_dir else ""), "eid", F.lit(".md"))
    fresh = stage(fresh.select((F.col("top") + F.col("n") + 1).alias("entity_id"), "eid", F.lit(lang).alias("preferred_lang"), F.lit(0).cast("bigint").alias("ref_count"), path.alias("path"), F.lit(now).alias("seen_scan"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at")), "new-entities")

    # a rewritten file is known by the hash of what it will hold; its time is not known yet
    written = texts.filter("changed").select("note_id", F.sha2("text", 256).alias("written"), F.octet_length("text").cast("bigint").alias("length"))
    told_of = rows.drop("text", "due").join(written, "note_id", "left")
    changed = F.col("written").isNotNull()
    told_of = told_of.withColumns({"hash": F.coalesce("written", "hash"), "size": F.coalesce("length", "size"), "mtime": F.when(~changed, F.col("mtime"))}).drop("written", "length")

    texts.join(rows.select("note_id", "path"), "note_id").select("path", "text", "changed", "passes").write.parquet(f"{out}/notes")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    present = files.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path")) if entity_dir else files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("path"))
    store.entity_views(named, present, lang, entity_dir).write.parquet(f"{out}/entity_views")
    return snapshots.replace_notes(base, due, mentions, conflicts, matches, now, told_of, fresh)
