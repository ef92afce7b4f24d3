"""What grows with the input is neither sent to the driver nor worked out twice."""

from pyspark.sql import functions as F

from lexweave.operators import graph, matching, policy, surfaces
from lexweave.sources import dumps


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_each_line_of_a_dump_is_parsed_once(spark):
    line = '{"id":"Q7","claims":{"P31":[{"mainsnak":{"datavalue":{"value":{"id":"Q5"}}}}],"P279":[]}},'
    rows = dumps.entity_claims(spark.createDataFrame([("[",), (line,), ("",), (None,), (line.replace("Q7", "L7"),), ("]",)], "value string"))
    assert plan_of(rows).count("from_json(") + plan_of(rows).count("JsonToStructs") == 1
    assert [(r["qid"], r["targets"]) for r in rows.collect()] == [("Q7", ["Q5"])]


def test_growing_tables_are_not_broadcast(spark):
    claims = spark.createDataFrame([(f"Q{k}", [f"Q{k // 2}"]) for k in range(1, 40)], "qid string, targets array<string>")
    nodes = spark.range(1, 40).select(F.col("id").alias("qid"))
    cards = surfaces.entity_cards(claims, nodes, spark.createDataFrame([(0, 1)], "anchor_id int, qid long"))
    assert "BroadcastExchange" not in plan_of(cards)
    assert {r["qid"]: r["colors"][0]["distance"] for r in cards.collect() if r["colors"]} == {k: k.bit_length() - 1 for k in range(1, 40)}
    lists = spark.createDataFrame([("a", ["Q1", "Q2"]), ("b", ["Q2"])], "surface_key string, qids array<string>")
    report = spark.createDataFrame([("Q1", True), ("Q2", False)], "qid string, report boolean")
    kept = policy.filter_candidates(lists, report)
    assert "BroadcastExchange" not in plan_of(kept) and [tuple(r) for r in kept.collect()] == [("a", ["Q1"])]


def test_many_reached_nodes_are_merged(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k // 2) for k in range(2, 200)] + [(k, k % 7) for k in range(2, 200)], "source long, target long")
    anchors = spark.createDataFrame([(0, 1), (1, 3)], "anchor_id int, qid long")
    want = sorted(map(tuple, graph.anchor_distances(edges, anchors).collect()))
    monkeypatch.setattr(graph, "beside", lambda rows, n: rows.hint("merge"))
    assert sorted(map(tuple, graph.anchor_distances(edges, anchors).collect())) == want and len(want) > 200


def test_hits_of_a_long_text_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(matching, "ROWS_AT_ONCE", 3)
    texts = ["ab" * 5, None, "", "xx", "b"]
    found = list(matching.hit_arrays(("ab", "b"), texts, "overlapping"))
    assert max(len(k) for k, *_ in found) <= 6 and len(found) > 3
    got = [row for part in found for row in zip(*(c.tolist() for c in part))]
    assert got == [(k, *h) for k, t in enumerate(texts) for h in matching.find(("ab", "b"), t or "", "overlapping")]


def test_counts_hold_one_row_a_pattern_and_batch(spark, monkeypatch):
    """Notes whose ids come once are summed in the scan; repeated ids, and null ones, count as before."""
    from collections import Counter

    rows = [(k, "ab b " * (k % 5)) for k in range(40)] + [(3, "ab"), (3, "xx"), (None, "ab ab"), (41, None), (42, "")]
    notes = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    words = spark.createDataFrame([(0, "ab"), (1, "b"), (2, "zz")], "surface_id int, pattern string")
    n, held = Counter(), {}
    for k, t in rows:
        for *_, i in matching.overlapping(("ab", "b", "zz"), t or ""):
            n[i] += 1
            held.setdefault(i, set()).add(k)
    want = sorted((w, n[i], len(held[i] - {None})) for i, w in enumerate(("ab", "b")))
    for most, at_once in ((1000, 50_000), (0, 50_000), (1000, 3), (0, 3)):
        monkeypatch.setattr(matching, "MOST_REPEATED", most)
        monkeypatch.setattr(matching, "ROWS_AT_ONCE", at_once)
        got = matching.count_matches(notes, words, "id", "text")
        assert sorted(tuple(r) for r in got.collect()) == want
    once = matching.count_matches(notes.filter("id > 3"), words, "id", "text")
    assert "note_id" not in plan_of(once).split("MapInArrow")[0].replace("isnull(note_id", "")
