"""Notes that need one, two, three and more passes."""

from lexweave.operators import notes as N
from lexweave.operators import passes

WORDS = ["Ask", "Tor", "Velm Tor"]


def test_notes_settle(spark):
    texts = {1: "nothing here", 2: "Ask", 3: "Ask\n\n[[wiki/Q7|---]]\n\nAsk", 4: None, 5: "[[wiki/Q4|Velm Tor]]", 6: ""}
    candidates = spark.createDataFrame([(0, ["Q5"]), (1, ["Q4"]), (2, ["Q2", "Q3"])], "surface_id int, eids array<string>")
    notes = spark.createDataFrame(list(texts.items()), "note_id long, text string")
    got = passes.settle(notes, WORDS, candidates)
    found = {r["note_id"]: (r["text"], r["changed"], r["passes"]) for r in got.texts.collect()}
    assert found == {
        1: ("nothing here", False, 1), 2: ("[[wiki/Q5|Ask]]", True, 2), 3: ("[[wiki/Q5|Ask]]\n\n---\n\n[[wiki/Q5|Ask]]", True, 3), 4: (None, None, 1), 5: ("[[wiki/Q4|Tor]]", True, 2), 6: ("", False, 1),
    }
    assert got.sizes == [6, 3, 1]
    # mentions are those of the final texts
    mentions = {(r["note_id"], r["eid"], r["source_start"], r["resolved"]) for r in N.mentions_of(got.groups).collect()}
    assert mentions == {(2, "Q5", 0, True), (3, "Q5", 0, True), (3, "Q5", 22, True), (5, "Q4", 0, True)}
    one = passes.settle(notes, WORDS, candidates, more=0)
    assert {r["note_id"]: r["text"] for r in one.texts.collect()}[3] == "[[wiki/Q5|Ask]]\n\n---\n\nAsk" and one.sizes == [6]


def test_stored_decisions_take_part(spark):
    candidates = spark.createDataFrame([(2, ["Q2", "Q3"])], "surface_id int, eids array<string>")
    notes = spark.createDataFrame([(1, "Velm Tor")], "note_id long, text string")
    first = passes.settle(notes, WORDS, candidates)
    assert first.texts.first()["text"] == "Velm Tor"
    told = N.conflict_matches_of(N.conflicts_of(first.groups)).selectExpr("hash", "surface", "surface_id", "start", "end", "'Q3' AS resolved_eid", "1 AS seq")
    assert passes.settle(notes, WORDS, candidates, stored=told).texts.first()["text"] == "[[wiki/Q3|Velm Tor]]"


def test_no_notes(spark):
    candidates = spark.createDataFrame([(0, ["Q5"])], "surface_id int, eids array<string>")
    got = passes.settle(spark.createDataFrame([], "note_id long, text string"), WORDS, candidates)
    assert got.texts.collect() == [] and got.sizes == [0]
