"""The sync command: from note files to rewritten notes, entity notes and versions of the store."""

import os

from lexweave.__main__ import main
from lexweave.operators import snapshots
from lexweave.operators.store import reference_counts


def test_notes_are_synced_again_only_where_they_changed(spark, tmp_path):
    notes, store = tmp_path / "notes", f"file://{tmp_path}/store"
    (notes / "wiki").mkdir(parents=True)
    (notes / "wiki/Q5.md").write_text("an entity note, no note of its own")
    for name, text in {"a": "Ask met Velm Tor", "b": "[[wiki/Q2|Velm Tor]] and Ask", "c": "nothing"}.items():
        (notes / f"{name}.md").write_text(text)
    spark.createDataFrame([("Ask", [5]), ("Velm Tor", [2, 3]), ("Tor", [4]), ("met", [9])], "surface_key string, qids array<long>").write.parquet(str(tmp_path / "tables/surfaces"))
    spark.createDataFrame([(2, True), (3, True), (4, False), (5, True), (9, False)], "qid long, report boolean").write.parquet(str(tmp_path / "tables/entities"))
    command = ["sync", "--tables", str(tmp_path / "tables"), "--notes", str(notes), "--store", store, "--lang", "en", "--out"]
    main([*command, str(tmp_path / "one")], spark)
    got = {r["path"]: (r["text"], r["changed"], r["passes"]) for r in spark.read.parquet(str(tmp_path / "one/notes")).collect()}
    assert got == {"a.md": ("[[wiki/Q5|Ask]] met Velm Tor", True, 2), "b.md": ("[[wiki/Q2|Velm Tor]] and [[wiki/Q5|Ask]]", True, 2), "c.md": ("nothing", False, 1)}
    assert {r["path"] for r in spark.read.parquet(str(tmp_path / "one/entity_views")).collect()} == {"wiki/Q2.md"}
    at = snapshots.latest(spark, store)
    counts = lambda s: {r["eid"]: r["ref_count"] for r in s.table("entities").collect()}
    assert counts(at) == {"Q5": 2, "Q2": 1}
    assert {(r["path"], r["status"], r["view_exists"]) for r in at.table("notes").collect()} == {("a.md", "synced", True), ("b.md", "synced", True), ("c.md", "synced", True)}
    assert at.table("mentions").filter("entity_id IS NULL").isEmpty() and at.table("conflicts").count() == 2

    # the owner puts the texts in place, changes one more note and deletes one
    for path, (text, _, _) in got.items():
        (notes / path).write_text(text)
    (notes / "b.md").unlink()
    (notes / "c.md").write_text("Ask")
    os.utime(notes / "c.md", (1, 1))
    main([*command, str(tmp_path / "two")], spark)
    assert {r["path"]: r["text"] for r in spark.read.parquet(str(tmp_path / "two/notes")).collect()} == {"c.md": "[[wiki/Q5|Ask]]"}
    now = snapshots.latest(spark, store)
    assert now.version == at.version + 1 and counts(now) == {"Q5": 3, "Q2": 1}
    assert {r["path"]: r["status"] for r in now.table("notes").collect()} == {"a.md": "synced", "b.md": "missing", "c.md": "synced"}
    full = reference_counts(now.table("entities"), now.table("mentions"), now.table("conflict_matches"))
    assert {r["eid"]: r["ref_count"] for r in full.collect()} == counts(now)
    assert counts(at) == {"Q5": 2, "Q2": 1}  # the version opened before still reads
