"""Commits of the note store: whole or not at all, no lost change, counts equal to a full recompute."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.operators import snapshots
from lexweave.operators.store import TABLES, reference_counts


def frame(spark, name, rows):
    columns = [c.split()[0] for c in TABLES[name].split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], TABLES[name])


def change(spark, rnd, ids):
    """Random mentions, conflicts and matches of the notes `ids`."""
    eid = lambda: f"Q{rnd.randint(1, 9)}"
    mentions = [{"note_id": n, "eid": eid(), "text": "m", "suspect": rnd.random() < 0.5, "resolved": rnd.random() < 0.5} for n in ids for _ in range(rnd.randint(0, 4))]
    conflicts = [{"note_id": n, "conflict_id": n * 10, "hash": "h"} for n in ids]
    matches = [{"note_id": n, "conflict_id": n * 10, "resolved_eid": rnd.choice([None, eid()])} for n in ids for _ in range(2)]
    return frame(spark, "notes", [{"note_id": n} for n in ids]).select("note_id"), frame(spark, "mentions", mentions), frame(spark, "conflicts", conflicts), frame(spark, "conflict_matches", matches)


@pytest.fixture
def store(spark, tmp_path):
    notes = frame(spark, "notes", [{"note_id": n, "path": f"n/{n}", "status": "modified"} for n in range(20)])
    entities = frame(spark, "entities", [{"entity_id": k, "eid": f"Q{k}", "ref_count": 0, "updated_at": 1} for k in range(1, 13)])
    return snapshots.create(spark, f"file://{tmp_path}/store", {"notes": notes, "entities": entities}, parts=4)


def counts(at):
    return {r["eid"]: r["ref_count"] for r in at.table("entities").select("eid", "ref_count").collect()}


def recomputed(at):
    return {r["eid"]: r["ref_count"] for r in reference_counts(at.table("entities"), at.table("mentions"), at.table("conflict_matches")).collect()}


def test_counts_equal_a_full_recompute_and_only_changed_parts_are_written(spark, store):
    rnd = random.Random(2)
    at, before = store, None
    for now, ids in enumerate((range(0, 12), range(8, 20), [3], [3, 19], []), 2):
        before, at = at, snapshots.replace_notes(at, *change(spark, rnd, list(ids)), now)
        assert counts(at) == recomputed(at) and len(counts(at)) == 12
        assert at.version == now and snapshots.latest(spark, at.root).folders == at.folders
    assert at.folders == before.folders  # nothing was touched last
    one = snapshots.replace_notes(at, *change(spark, rnd, [5]), 9)
    assert sum(one.folders["mentions"].get(p) != at.folders["mentions"].get(p) for p in range(4)) <= 1
    assert {r["status"] for r in one.table("notes").collect()} == {"synced"}
    assert one.table("mentions").filter("entity_id IS NULL OR concat('Q', entity_id) <> eid").isEmpty()
    touched = {r["eid"] for r in one.table("entities").filter("updated_at = 9").collect()}
    assert touched == {e for e in counts(one) if counts(one)[e] != counts(at)[e]}


def test_a_failure_between_tables_leaves_the_old_version(spark, store, monkeypatch):
    first = snapshots.replace_notes(store, *change(spark, random.Random(3), range(20)), 2)
    held = {name: sorted(map(str, first.table(name).collect())) for name in TABLES}
    write = snapshots._write

    def broken(at, name, rows):
        if name == "entities":
            raise OSError("lost")
        return write(at, name, rows)

    monkeypatch.setattr(snapshots, "_write", broken)
    with pytest.raises(OSError):
        snapshots.replace_notes(first, *change(spark, random.Random(4), range(20)), 3)
    now = snapshots.latest(spark, first.root)
    assert now.version == first.version
    assert {name: sorted(map(str, now.table(name).collect())) for name in TABLES} == held


def test_of_two_changes_on_one_version_one_wins(spark, store):
    won = snapshots.replace_notes(store, *change(spark, random.Random(5), [1]), 2)
    with pytest.raises(snapshots.ConflictError):
        snapshots.replace_notes(store, *change(spark, random.Random(6), [2]), 2)
    assert snapshots.latest(spark, store.root).folders == won.folders
    # readers keep what they have opened
    assert counts(store) == {f"Q{k}": 0 for k in range(1, 13)}
    again = snapshots.replace_notes(snapshots.latest(spark, store.root), *change(spark, random.Random(6), [2]), 3)
    assert counts(again) == recomputed(again)


def test_rows_of_other_notes_are_an_error(spark, store):
    notes, mentions, conflicts, matches = change(spark, random.Random(7), [1, 2])
    with pytest.raises(ValueError):
        snapshots.replace_notes(store, notes.filter(F.col("note_id") == 1), mentions, conflicts, matches, 2)
