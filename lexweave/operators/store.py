"""The note store as tables: merges, reference counts, decision inheritance, cascades and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.surfaces import dense_ids

# The tables of a store; a Parquet folder each.
TABLES = {
    "model_meta": "key string, value string",
    "notes": "note_id long, path string, status string, view_exists boolean, mtime long, size long, hash string, seen_scan long, scanned_at long, created_at long, updated_at long",
    "entities": "entity_id long, eid string, preferred_lang string, ref_count long, path string, seen_scan long, created_at long, updated_at long",
    "mentions": "note_id long, entity_id long, eid string, text string, surface_id int, source_start int, source_end int, suspect boolean, resolved boolean",
    "conflicts": "note_id long, conflict_id long, hash string, text string, source_start int, source_end int, left_context string, right_context string",
    "conflict_matches": "note_id long, conflict_id long, resolved_eid string, surface string, surface_id int, source_start int, source_end int, eids array<string>",
}
SCHEMA_VERSION = "1"


def create_store(spark: SparkSession, root: str) -> None:
    """Empty tables where there are none yet, and the schema's version."""
    for name, schema in TABLES.items():
        rows = [("schema_version", SCHEMA_VERSION)] if name == "model_meta" else []
        spark.createDataFrame(rows, schema).write.mode("overwrite" if name == "model_meta" else "ignore").parquet(f"{root}/{name}")


def ensure_notes(notes: DataFrame, seen: DataFrame, now: int) -> DataFrame:
    """`notes` (note_id, path, status, view_exists, created_at, updated_at) with the paths of `seen`.

    A known note is marked as there and touched; a new one gets the next free id, in path order, and is modified.
    """
    paths = seen.select("path").distinct()
    touched = notes.join(paths.withColumn("hit", F.lit(True)), "path", "left")
    kept = touched.select("note_id", "path", "status", (F.col("view_exists") | F.coalesce("hit", F.lit(False))).alias("view_exists"), "created_at", F.when(F.col("hit"), now).otherwise(F.col("updated_at")).cast("bigint").alias("updated_at"))
    top = notes.agg(F.coalesce(F.max("note_id"), F.lit(0)).alias("top"))  # one row
    fresh = dense_ids(paths.join(notes.select("path"), "path", "left_anti"), "path", "n").join(F.broadcast(top))
    made = fresh.select((F.col("top") + F.col("n") + 1).alias("note_id"), "path", F.lit("modified").alias("status"), F.lit(True).alias("view_exists"), F.lit(now).cast("bigint").alias("created_at"), F.lit(now).cast("bigint").alias("updated_at"))
    return kept.unionByName(made)


def replace_of_notes(old: DataFrame, new: DataFrame, notes: DataFrame) -> DataFrame:
    """`old` rows (mentions, conflicts or their matches) of other notes, and the `new` ones of `notes` (note_id)."""
    return old.join(notes.select("note_id").distinct(), "note_id", "left_anti").unionByName(new)


def with_entity_ids(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """`mentions` with the entity_id of their eid; null for one that the store doesn't know."""
    return mentions.join(entities.select("eid", "entity_id"), "eid", "left")


def entities_by_id(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """The entities of `ids` (entity_id), each once; an id that the store doesn't know gives none."""
    return entities.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")


def stored_resolutions(conflicts: DataFrame, matches: DataFrame) -> DataFrame:
    """Decided matches of conflicts, with the columns that inherit_decisions() compares."""
    won = matches.filter(F.col("resolved_eid").isNotNull())
    return conflicts.select("conflict_id", "note_id", "hash").join(won, "conflict_id")


def entity_views(entities: DataFrame, present: DataFrame, lang: str, folder: str = "wiki") -> DataFrame:
    """(path, text) of the entity notes that are not among `present` (path)."""
    path = F.concat(F.lit(f"{folder}/" if folder else ""), "eid", F.lit(".md"))
    text = F.concat(F.lit("---\nEID: "), "eid", F.lit(f"\nPreferredLang: {lang}\n---\n"))
    return entities.select(path.alias("path"), text.alias("text")).join(present.select("path"), "path", "left_anti")


def notes_with_status(notes: DataFrame, status: str) -> DataFrame:
    return notes.filter(F.col("status") == status).orderBy("note_id")


def _unseen(scan: int) -> Column:
    return ~F.col("seen_scan").eqNullSafe(F.lit(scan))


def stale_notes(notes: DataFrame, scan: int) -> DataFrame:
    """Notes said to be there that the scan has not seen."""
    return notes.filter(F.col("view_exists") & _unseen(scan)).orderBy("note_id")


def unreferenced_entities(entities: DataFrame) -> DataFrame:
    return entities.filter("ref_count = 0").orderBy("entity_id")


def stale_entities(entities: DataFrame, scan: int) -> DataFrame:
    return entities.filter(_unseen(scan)).orderBy("entity_id")


def children_in_order(rows: DataFrame, parent: str, value: int, id_col: str) -> DataFrame:
    """Mentions or conflicts of a note, or matches of a conflict, by place."""
    return rows.filter(F.col(parent) == value).orderBy("source_start", id_col)


def effective(suspect: Column, resolved: Column) -> Column:
    return ~suspect | resolved


def merge_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """`existing` with the incoming rows of new keys; rows of a known key stay as they are."""
    fresh = incoming.join(existing.select(key), key, "left_anti").dropDuplicates([key])
    return existing.unionByName(fresh)


def mark_synced(notes: DataFrame, seen: DataFrame) -> DataFrame:
    """Notes with the observation of `seen` (note_id, mtime, size, hash) where there is one."""
    joined = notes.alias("n").join(seen.alias("s"), "note_id", "left")
    hit = F.col("s.hash").isNotNull()
    return joined.select("note_id", F.when(hit, "synced").otherwise(F.col("n.status")).alias("status"), *[F.coalesce(f"s.{c}", f"n.{c}").alias(c) for c in ("mtime", "size", "hash")])


def reference_counts(entities: DataFrame, mentions: DataFrame, conflict_matches: DataFrame) -> DataFrame:
    """(eid, ref_count) of every entity: effective mentions and resolved conflict matches."""
    own = mentions.filter(effective(F.col("suspect"), F.col("resolved"))).groupBy("eid").agg(F.count(F.lit(1)).alias("n"))
    won = conflict_matches.filter(F.col("resolved_eid").isNotNull()).groupBy(F.col("resolved_eid").alias("eid")).agg(F.count(F.lit(1)).alias("n"))
    sums = own.unionByName(won).groupBy("eid").agg(F.sum("n").alias("n"))
    return entities.select("eid").join(sums, "eid", "left").select("eid", F.coalesce("n", F.lit(0)).cast("bigint").alias("ref_count"))


def inherit_decisions(matches: DataFrame, stored: DataFrame) -> DataFrame:
    """Matches with resolved_eid taken from stored decisions of the same key, if still a candidate."""
    keys = ["hash", "surface", "surface_id", "start", "end"]
    last = stored.groupBy(*keys).agg(F.max_by("resolved_eid", "seq").alias("stored_eid"))
    joined = matches.join(last, keys, "left")
    ok = F.col("resolved_eid").isNull() & F.array_contains("eids", F.col("stored_eid"))
    return joined.withColumn("resolved_eid", F.when(ok, F.col("stored_eid")).otherwise(F.col("resolved_eid"))).drop("stored_eid")


def cascade_delete(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key), key, "left_semi")


def status_changes(notes: DataFrame, scan: DataFrame) -> DataFrame:
    """(path, status) from a scan of the files against stored notes: new, missing, unchanged or modified.

    An equal modification time counts as unchanged; otherwise the hash decides.
    """
    both = notes.alias("n").join(scan.alias("s"), "path", "full")
    status = F.when(F.col("n.hash").isNull(), "new").when(F.col("s.hash").isNull(), "missing").when(F.col("n.mtime") == F.col("s.mtime"), "unchanged").when(F.col("n.hash") == F.col("s.hash"), "unchanged").otherwise("modified")
    return both.select("path", status.alias("status"))


def violations(mentions: DataFrame, notes: DataFrame) -> DataFrame:
    """(rule, n): broken constraints of the store, counted."""
    bad = mentions.agg(F.count_if(~((F.col("start") >= 0) & (F.col("end") > F.col("start")))).alias("n")).withColumn("rule", F.lit("mention_range"))
    lost = mentions.join(notes.select("note_id"), "note_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit("mention_note"))
    return bad.unionByName(lost).select("rule", "n")
