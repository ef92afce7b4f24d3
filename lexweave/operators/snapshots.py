"""Versions of a note store: all tables of a change become visible at once, and concurrent changes can't both win.

A table is cut into `parts` by a hash of its key, and a version is a small file that names the folder of every part
of every table. A change writes the parts that it touches to new folders, reads the others where they are, and
is committed by creating the file of the next version, which fails if there is one already. Until then, and
after a failure anywhere before, readers see the version before. Readers keep the version they opened.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.store import TABLES, effective

KEYS = {"model_meta": "key", "notes": "note_id", "entities": "eid", "mentions": "note_id", "conflicts": "note_id", "conflict_matches": "note_id"}
PARTS = 64


class ConflictError(RuntimeError):
    """Another change was committed since the version that this one has read."""


@dataclass(frozen=True)
class Snapshot:
    """One version of the store under `root`."""

    spark: SparkSession
    root: str
    version: int
    parts: int
    folders: dict[str, dict[int, str]]  # by table and part

    def table(self, name: str, only: list[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its parts."""
        paths = [path for part, path in self.folders[name].items() if only is None or part in only]
        reader = self.spark.read.schema(TABLES[name])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def part_of(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")


def _fs(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _commit(spark: SparkSession, root: str, version: int, parts: int, folders: dict[str, dict[int, str]]) -> Snapshot:
    path, fs = _fs(spark, f"{root}/versions/{version:012}.json")
    try:
        out = fs.create(path, False)
    except Py4JJavaError as error:
        if fs.exists(path):
            raise ConflictError(f"version {version} is there already") from error
        raise
    out.write(bytearray(json.dumps({"parts": parts, "folders": folders}).encode()))
    out.close()
    return Snapshot(spark, root, version, parts, folders)


def create(spark: SparkSession, root: str, tables: dict[str, DataFrame] | None = None, parts: int = PARTS) -> Snapshot:
    """The first version, of `tables` or empty."""
    empty = Snapshot(spark, root, 0, parts, {name: {} for name in TABLES})
    meta = spark.createDataFrame([("schema_version", "1")], TABLES["model_meta"])
    folders = {name: _write(empty, name, rows) for name, rows in ({"model_meta": meta} | (tables or {})).items()}
    return _commit(spark, root, 1, parts, empty.folders | folders)


def exists(spark: SparkSession, root: str) -> bool:
    path, fs = _fs(spark, f"{root}/versions")
    return fs.exists(path)


def latest(spark: SparkSession, root: str) -> Snapshot:
    """The newest version that is complete."""
    folder, fs = _fs(spark, f"{root}/versions")
    for name in sorted((s.getPath().toString() for s in fs.listStatus(folder)), reverse=True):
        lines = spark.read.text(name, wholetext=True).collect()  # one small file
        try:
            found = json.loads(lines[0]["value"])
        except (IndexError, ValueError):
            continue  # its writer is not done yet
        folders = {table: {int(part): path for part, path in held.items()} for table, held in found["folders"].items()}
        return Snapshot(spark, root, int(name.rpartition("/")[2].removesuffix(".json")), found["parts"], folders)
    raise FileNotFoundError(f"no version under {root}")


def _write(at: Snapshot, name: str, rows: DataFrame) -> dict[int, str]:
    """Write `rows` by part to a new folder; the folders of the parts that have rows."""
    folder = f"{at.root}/data/{uuid.uuid4().hex}/{name}"
    part = at.part_of(KEYS[name])
    columns = [F.col(c.split()[0]).cast(c.split()[1]) for c in TABLES[name].split(", ")]
    rows.select(*columns, part.alias("part")).repartition("part").write.partitionBy("part").parquet(folder)
    path, fs = _fs(at.spark, folder)
    found = (s.getPath() for s in fs.listStatus(path))
    return {int(p.getName().partition("=")[2]): p.toString() for p in found if p.getName().startswith("part=")}


def commit(base: Snapshot, changed: dict[str, tuple[DataFrame, list[int]]]) -> Snapshot:
    """The next version: of each changed table (rows, touched parts), where the rows are all that those parts hold from now on."""
    folders = dict(base.folders)
    for name, (rows, touched) in changed.items():
        folders[name] = {p: f for p, f in base.folders[name].items() if p not in touched} | _write(base, name, rows)
    return _commit(base.spark, base.root, base.version + 1, base.parts, folders)


def _touched(base: Snapshot, keys: DataFrame, key: str) -> list[int]:
    return [r["part"] for r in keys.select(base.part_of(key).alias("part")).distinct().collect()]  # as many rows as parts at most


def references(mentions: DataFrame, conflict_matches: DataFrame) -> DataFrame:
    """(eid, n): effective mentions and resolved conflict matches."""
    own = mentions.filter(effective(F.col("suspect"), F.col("resolved"))).select("eid")
    won = conflict_matches.filter(F.col("resolved_eid").isNotNull()).select(F.col("resolved_eid").alias("eid"))
    return own.unionByName(won).groupBy("eid").agg(F.count(F.lit(1)).alias("n"))


def replace_notes(base: Snapshot, notes: DataFrame, mentions: DataFrame, conflicts: DataFrame, conflict_matches: DataFrame, now: int, observed: DataFrame | None = None, new_entities: DataFrame | None = None) -> Snapshot:
    """Commit new mentions, conflicts and matches of `notes` (note_id) together with what hangs on them.

    The notes become synced, and the counts of the entities that gain or lose references change by the difference;
    entities that nothing refers to any more stay with a count of 0. A mention's entity_id follows its eid. Rows of
    notes that aren't among `notes` are an error. `observed` replaces or adds whole rows of notes, and `new_entities` (eids
    that the version doesn't have) come in with the same commit.
    """
    new = {"mentions": mentions, "conflicts": conflicts, "conflict_matches": conflict_matches}
    keys = notes.select("note_id").distinct()
    for name, rows in new.items():
        if not rows.join(keys, "note_id", "left_anti").isEmpty():
            raise ValueError(f"{name} of notes that aren't replaced")
    parts = _touched(base, keys, "note_id")
    old = {name: base.table(name, parts) for name in new}
    gone = {name: rows.join(keys, "note_id", "left_semi") for name, rows in old.items()}
    before = references(gone["mentions"], gone["conflict_matches"]).select("eid", (-F.col("n")).alias("n"))
    after = references(mentions, conflict_matches)
    moved = before.unionByName(after).groupBy("eid").agg(F.sum("n").alias("moved")).filter("moved <> 0")

    none = base.spark.createDataFrame([], TABLES["entities"])
    new_entities = none if new_entities is None else new_entities.select(*none.columns)
    entity_parts = _touched(base, moved.select("eid").unionByName(new_entities.select("eid")), "eid")
    entities = base.table("entities", entity_parts).unionByName(new_entities).join(moved, "eid", "left")
    moves = F.coalesce("moved", F.lit(0))
    entities = entities.withColumns({"ref_count": F.coalesce("ref_count", F.lit(0)) + moves, "updated_at": F.when(moves != 0, F.lit(now)).otherwise(F.col("updated_at"))}).drop("moved")

    named = mentions.drop("entity_id").join(base.table("entities").unionByName(new_entities).select("eid", "entity_id"), "eid", "left")
    kept = {name: rows.join(keys, "note_id", "left_anti") for name, rows in old.items()}
    rows = {name: kept[name].unionByName(named if name == "mentions" else new[name]) for name in new}
    hit, note_parts, stored = keys.withColumn("hit", F.lit(True)), parts, base.table("notes", parts)
    if observed is not None:
        note_parts = sorted({*parts, *_touched(base, observed, "note_id")})
        stored = base.table("notes", note_parts).join(observed.select("note_id"), "note_id", "left_anti").unionByName(observed.select(*stored.columns))
    seen = stored.join(hit, "note_id", "left")
    seen = seen.withColumns({"status": F.when(F.col("hit"), "synced").otherwise(F.col("status")), "updated_at": F.when(F.col("hit"), F.lit(now)).otherwise(F.col("updated_at"))}).drop("hit")
    return commit(base, {name: (r, parts) for name, r in rows.items()} | {"notes": (seen, note_parts), "entities": (entities, entity_parts)})
