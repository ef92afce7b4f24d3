"""Queries over the note store: new notes, replaced mentions, stored decisions, and its ordered listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import snapshots, statistics, store
from lexweave.plans.registry import query
from lexweave.session import table
from lexweave.staging import shared_path

SCAN = 2
ALL = "SELECT * REPLACE (coalesce(seen_scan, -1) AS seen_scan)"


def _shown(rows):
    """-1 for a scan that never was, so that results compare as whole numbers."""
    return rows.withColumn("seen_scan", F.coalesce("seen_scan", F.lit(-1)))


def _notes(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "synced").when(F.col("o_orderstatus") == "O", "modified").otherwise("missing")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("note_id"), F.concat(F.lit("n/"), "o_orderkey", F.lit(".md")).alias("path"), status.alias("status"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 3).alias("seen_scan"))
    return rows.withColumn("view_exists", F.col("status") != "missing")


NOTES_SQL = """notes AS (SELECT o_orderkey AS note_id, 'n/' || o_orderkey || '.md' AS path, CASE o_orderstatus WHEN 'F' THEN 'synced' WHEN 'O' THEN 'modified' ELSE 'missing' END AS status,
  CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 3 END AS seen_scan, o_orderstatus IN ('F', 'O') AS view_exists FROM orders)"""


def _entities(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("Q"), "s_suppkey").alias("eid"), (F.col("s_suppkey") % 4).cast("bigint").alias("ref_count"), F.when(F.col("s_nationkey") % 3 != 0, F.col("s_nationkey") % 3).cast("bigint").alias("seen_scan"))
    return rows


ENTITIES_SQL = """entities AS (SELECT s_suppkey AS entity_id, 'Q' || s_suppkey AS eid, (s_suppkey % 4)::BIGINT AS ref_count, (CASE WHEN s_nationkey % 3 <> 0 THEN s_nationkey % 3 END)::BIGINT AS seen_scan FROM supplier)"""


def _mentions(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("note_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mention_id"), F.concat(F.lit("Q"), F.col("l_suppkey") + 1).alias("eid"), (F.col("l_partkey") % 50).cast("int").alias("source_start"))


MENTIONS_SQL = """mentions AS (SELECT l_orderkey AS note_id, l_orderkey * 10 + l_linenumber AS mention_id, 'Q' || (l_suppkey + 1) AS eid, (l_partkey % 50)::INT AS source_start FROM lineitem)"""


@query("""WITH old AS (SELECT c_custkey AS note_id, 'n/' || c_custkey AS path, CASE WHEN c_custkey % 2 = 0 THEN 'synced' ELSE 'missing' END AS status, c_custkey % 2 = 0 AS view_exists FROM customer WHERE c_custkey % 5 <> 0),
seen AS (SELECT DISTINCT 'n/' || (o_custkey % 400) AS path FROM orders)
SELECT note_id, path, status, view_exists OR path IN (SELECT path FROM seen) AS view_exists, 1::BIGINT AS created_at, (CASE WHEN path IN (SELECT path FROM seen) THEN 9 ELSE 1 END)::BIGINT AS updated_at FROM old
UNION ALL SELECT (SELECT max(note_id) FROM old) + row_number() OVER (ORDER BY path), path, 'modified', true, 9, 9 FROM seen WHERE path NOT IN (SELECT path FROM old)""")
def note_upsert(spark, d):
    k, one = F.col("c_custkey"), F.lit(1).cast("bigint")
    old = table(spark, d, "customer").filter("c_custkey % 5 <> 0").select(k.alias("note_id"), F.concat(F.lit("n/"), k).alias("path"), F.when(k % 2 == 0, "synced").otherwise("missing").alias("status"), (k % 2 == 0).alias("view_exists"), one.alias("created_at"), one.alias("updated_at"))
    return store.ensure_notes(old, table(spark, d, "orders").select(F.concat(F.lit("n/"), F.col("o_custkey") % 400).alias("path")), 9)


@query(f"""WITH {MENTIONS_SQL}, synced AS (SELECT o_orderkey AS note_id FROM orders WHERE o_orderkey % 3 = 0)
SELECT note_id, mention_id, eid, source_start FROM mentions WHERE note_id NOT IN (SELECT note_id FROM synced)
UNION ALL SELECT note_id, -mention_id, 'Q1', source_start + 1 FROM mentions WHERE note_id IN (SELECT note_id FROM synced) AND mention_id % 2 = 0""")
def replaced_mentions(spark, d):
    """Notes that are synced again lose all their old mentions and get new ones, maybe none."""
    old = _mentions(spark, d)
    synced = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("note_id"))
    new = old.join(synced, "note_id", "left_semi").filter("mention_id % 2 = 0").select("note_id", (-F.col("mention_id")).alias("mention_id"), F.lit("Q1").alias("eid"), (F.col("source_start") + 1).alias("source_start"))
    return store.replace_of_notes(old, new, synced)


def _decisions(spark, d):
    conflicts = table(spark, d, "orders").select(F.col("o_orderkey").alias("conflict_id"), (F.col("o_orderkey") % 500).alias("note_id"), F.concat(F.lit("h"), F.col("o_custkey") % 40).alias("hash"), (F.col("o_custkey") % 30).cast("int").alias("source_start"))
    matches = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("conflict_id"), F.col("l_linenumber").alias("match_id"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Q"), "l_suppkey")).alias("resolved_eid"), F.col("l_partkey").cast("int").alias("surface_id"), (F.col("l_partkey") % 50).cast("int").alias("source_start"))
    return conflicts, matches


DECISIONS_SQL = """conflicts AS (SELECT o_orderkey AS conflict_id, o_orderkey % 500 AS note_id, 'h' || (o_custkey % 40) AS hash, (o_custkey % 30)::INT AS source_start FROM orders),
matches AS (SELECT l_orderkey AS conflict_id, l_linenumber AS match_id, CASE WHEN l_returnflag = 'R' THEN 'Q' || l_suppkey END AS resolved_eid, l_partkey::INT AS surface_id, (l_partkey % 50)::INT AS source_start FROM lineitem)"""


@query(f"WITH {DECISIONS_SQL} SELECT note_id, hash, m.match_id, m.resolved_eid, m.surface_id, m.source_start FROM conflicts JOIN matches m USING (conflict_id) WHERE resolved_eid IS NOT NULL")
def stored_resolutions(spark, d):
    return store.stored_resolutions(*_decisions(spark, d)).drop("conflict_id")


@query(f"WITH {NOTES_SQL} {ALL} FROM notes WHERE status = 'missing'")
def missing_notes(spark, d):
    return _shown(store.notes_with_status(_notes(spark, d), "missing"))


@query(f"WITH {NOTES_SQL} {ALL} FROM notes WHERE status = 'modified'")
def modified_notes(spark, d):
    return _shown(store.notes_with_status(_notes(spark, d), "modified"))


@query(f"WITH {NOTES_SQL} {ALL} FROM notes WHERE view_exists AND (seen_scan IS NULL OR seen_scan <> {SCAN})")
def stale_notes(spark, d):
    return _shown(store.stale_notes(_notes(spark, d), SCAN))


@query(f"WITH {ENTITIES_SQL} {ALL} FROM entities WHERE ref_count = 0")
def unreferenced_entities(spark, d):
    return _shown(store.unreferenced_entities(_entities(spark, d)))


@query(f"WITH {ENTITIES_SQL} {ALL} FROM entities WHERE seen_scan IS NULL OR seen_scan <> {SCAN}")
def stale_entities(spark, d):
    return _shown(store.stale_entities(_entities(spark, d), SCAN))


def _placed(rows, id_col):
    """The order as a column, as a result's hash doesn't see it."""
    from pyspark.sql import Window as W

    return rows.withColumn("place", F.row_number().over(W.orderBy("source_start", id_col)))  # one parent's rows


@query(f"WITH {MENTIONS_SQL} SELECT *, row_number() OVER (ORDER BY source_start, mention_id)::INT AS place FROM mentions WHERE note_id = 7")
def note_mentions_ordered(spark, d):
    return _placed(store.children_in_order(_mentions(spark, d), "note_id", 7, "mention_id"), "mention_id")


@query(f"WITH {DECISIONS_SQL} SELECT *, row_number() OVER (ORDER BY source_start, conflict_id)::INT AS place FROM conflicts WHERE note_id = 7")
def note_conflicts_ordered(spark, d):
    return _placed(store.children_in_order(_decisions(spark, d)[0], "note_id", 7, "conflict_id"), "conflict_id")


@query(f"WITH {DECISIONS_SQL} SELECT *, row_number() OVER (ORDER BY source_start, match_id)::INT AS place FROM matches WHERE conflict_id = 7")
def conflict_matches_ordered(spark, d):
    return _placed(store.children_in_order(_decisions(spark, d)[1], "conflict_id", 7, "match_id"), "match_id")


@query(f"WITH {MENTIONS_SQL}, {ENTITIES_SQL} SELECT mention_id, m.eid, coalesce(entity_id, -1) AS entity_id FROM mentions m LEFT JOIN entities e ON e.eid = m.eid")
def mention_entity_ids(spark, d):
    return store.with_entity_ids(_mentions(spark, d), _entities(spark, d)).select("mention_id", "eid", F.coalesce("entity_id", F.lit(-1)).alias("entity_id"))


@query(f"WITH {ENTITIES_SQL} SELECT 'wiki/' || eid || '.md' AS path, '---' || chr(10) || 'EID: ' || eid || chr(10) || 'PreferredLang: zh' || chr(10) || '---' || chr(10) AS text FROM entities WHERE entity_id % 2 = 1")
def entity_views(spark, d):
    """Views of entities that have none yet."""
    entities = _entities(spark, d)
    present = entities.filter("entity_id % 2 = 0").select(F.concat(F.lit("wiki/"), "eid", F.lit(".md")).alias("path"))
    return store.entity_views(entities, present, "zh")


@query(f"""WITH {MENTIONS_SQL}, {DECISIONS_SQL}, a AS (SELECT note_id, count(*) AS n FROM mentions GROUP BY 1), b AS (SELECT note_id, count(*) AS n FROM conflicts GROUP BY 1), c AS (SELECT note_id, count(*) AS n FROM matches JOIN conflicts USING (conflict_id) GROUP BY 1)
SELECT coalesce(a.note_id, b.note_id, c.note_id) AS note_id, coalesce(a.n, 0) AS mentions, coalesce(b.n, 0) AS conflicts, coalesce(c.n, 0) AS conflict_matches FROM a FULL JOIN b ON a.note_id = b.note_id FULL JOIN c ON c.note_id = coalesce(a.note_id, b.note_id)""")
def sync_counts(spark, d):
    conflicts, matches = _decisions(spark, d)
    return statistics.sync_counts(_mentions(spark, d), conflicts, matches.join(conflicts.select("conflict_id", "note_id"), "conflict_id"))


def _committed(spark, d):
    """A store of suppliers and line items in which every third order's notes are synced again, in one commit."""
    ids = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("note_id"), ids.alias("id"), F.concat(F.lit("Q"), "l_suppkey").alias("eid"), F.concat(F.lit("Q"), F.col("l_suppkey") % 7 + 1).alias("other"), (F.col("l_returnflag") == "R").alias("suspect"), (F.col("l_linestatus") == "F").alias("resolved"))
    shape = lambda name, **have: [have.get(c.split()[0], F.lit(None)).cast(c.split()[1]).alias(c.split()[0]) for c in store.TABLES[name].split(", ")]
    n = F.col("note_id")
    notes = table(spark, d, "orders").select(F.col("o_orderkey").alias("note_id")).select(*shape("notes", note_id=n, path=F.concat(F.lit("n/"), n), status=F.lit("modified")))
    mentions = line.select(*shape("mentions", note_id=n, eid=F.col("eid"), suspect=F.col("suspect"), resolved=F.col("resolved")))
    matches = line.filter("id % 4 = 0").select(*shape("conflict_matches", note_id=n, conflict_id=F.col("id"), resolved_eid=F.when(F.col("resolved"), F.col("other"))))
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("Q"), "s_suppkey").alias("eid"))
    entities = known.join(store.reference_counts(known, mentions, matches), "eid").select(*shape("entities", entity_id=F.col("entity_id"), eid=F.col("eid"), ref_count=F.col("ref_count")))
    first = snapshots.create(spark, shared_path(spark, "store"), {"notes": notes, "entities": entities, "mentions": mentions, "conflict_matches": matches}, parts=8)
    again = line.filter("note_id % 3 = 0")
    return snapshots.replace_notes(
        first, notes.filter("note_id % 3 = 0"), again.filter("id % 2 = 0").select(*shape("mentions", note_id=n, eid=F.col("other"), suspect=F.lit(False), resolved=F.lit(False))),
        spark.createDataFrame([], store.TABLES["conflicts"]), again.filter("id % 5 = 0").select(*shape("conflict_matches", note_id=n, conflict_id=F.col("id"), resolved_eid=F.col("eid"))), 9,
    )


COMMITTED_SQL = """line AS (
  SELECT l_orderkey AS note_id, l_orderkey * 10 + l_linenumber AS id, 'Q' || l_suppkey AS eid, 'Q' || (l_suppkey % 7 + 1) AS other, l_returnflag = 'R' AS suspect, l_linestatus = 'F' AS resolved FROM lineitem
), mentions AS (
  SELECT note_id, eid, NOT suspect OR resolved AS effective FROM line WHERE note_id % 3 <> 0 UNION ALL SELECT note_id, other, true FROM line WHERE note_id % 3 = 0 AND id % 2 = 0
), matches AS (
  SELECT note_id, CASE WHEN resolved THEN other END AS eid FROM line WHERE note_id % 3 <> 0 AND id % 4 = 0 UNION ALL SELECT note_id, eid FROM line WHERE note_id % 3 = 0 AND id % 5 = 0
), refs AS (
  SELECT eid, count(*) AS n FROM (SELECT eid FROM mentions WHERE effective UNION ALL SELECT eid FROM matches WHERE eid IS NOT NULL) GROUP BY eid
)"""


@query(f"WITH {COMMITTED_SQL} SELECT 'Q' || s_suppkey AS eid, coalesce(n, 0)::BIGINT AS ref_count FROM supplier LEFT JOIN refs ON refs.eid = 'Q' || s_suppkey")
def committed_ref_counts(spark, d):
    """Counts that a commit has changed by differences, against a full recompute."""
    return _committed(spark, d).table("entities").select("eid", "ref_count")


@query(f"""WITH {COMMITTED_SQL}, kinds AS (
  SELECT 'mentions' AS kind, note_id, eid FROM mentions UNION ALL SELECT 'conflict_matches', note_id, eid FROM matches
  UNION ALL SELECT 'notes', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'synced' ELSE 'modified' END FROM orders
) SELECT kind, coalesce(eid, '') AS eid, count(*) AS n, sum(note_id)::BIGINT AS note_ids FROM kinds GROUP BY kind, coalesce(eid, '')""")
def committed_tables(spark, d):
    """What the tables of a committed version hold."""
    at = _committed(spark, d)
    rows = [at.table(name).select(F.lit(name).alias("kind"), "note_id", F.coalesce(shown, F.lit("")).alias("eid")) for name, shown in (("mentions", F.col("eid")), ("conflict_matches", F.col("resolved_eid")), ("notes", F.col("status")))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("kind", "eid").agg(F.count(F.lit(1)).alias("n"), F.sum("note_id").alias("note_ids"))


@query(f"WITH {ENTITIES_SQL} SELECT entity_id, eid, ref_count FROM entities WHERE entity_id IN (SELECT l_suppkey FROM lineitem WHERE l_partkey % 50 = 0 UNION ALL SELECT 0)")
def entities_by_id(spark, d):
    ids = table(spark, d, "lineitem").filter("l_partkey % 50 = 0").select(F.col("l_suppkey").alias("entity_id"))
    return store.entities_by_id(_entities(spark, d), ids.unionByName(spark.range(1).select(F.col("id").alias("entity_id")))).select("entity_id", "eid", "ref_count")
