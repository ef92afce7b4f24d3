"""Pieces, mentions, conflicts, rewriting and streams of notes."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions.markdown import entity_path, percent_decoded, pieces, shown_name
from lexweave.operators import notes as N
from lexweave.plans import adapters
from lexweave.streaming import sync


def kinds(text):
    return [(p.syntax, p.text) for p in pieces(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []),
        ("---\na: 1\n---\nx", [("frontmatter", "---\na: 1\n---\n"), ("text", "x")]),
        ("a\n\n---\nb", [("text", "a\n\n"), ("thematic_break", "---\n"), ("text", "b")]),
        ("a\n---\n", [("text", "a\n---\n")]),
        ("> q\n > r\nx", [("blockquote", "> q\n > r\n"), ("text", "x")]),
        ("|a|b|\n|--|--|\n", [("text", "|a|b|\n|--|--|\n")]),
        ("|a|b|\n|---|:-:|\n", [("text", "|a|b|\n|---|:-:|\n")]),
        ("a|b\n---|:---:\n1|2\nx", [("markdown_table", "a|b\n---|:---:\n1|2\n"), ("text", "x")]),
        ("a\\|b\n---|---\n", [("text", "a\\|b\n---|---\n")]),
        ("```py\n*x*\n```\ny", [("fenced_code", "```py\n*x*\n```\n"), ("text", "y")]),
        ("~~~\nx", [("fenced_code", "~~~\nx")]),
        ("a <!-- b --> c", [("text", "a "), ("html_comment", "<!-- b -->"), ("text", " c")]),
        ("<B>x</b>y <br>", [("html", "<B>x</b>"), ("text", "y "), ("html", "<br>")]),
        ("1 < 2", [("text", "1 < 2")]),
        ("![[p]] [[p]]", [("wikilink", "![[p]]"), ("text", " "), ("wikilink", "[[p]]")]),
        ("[[wiki/Q5|é]]", [("link", "é")]),
        ("[x](wiki/Q5.md 't')", [("link", "x")]),
        ("[[wiki/a#b]]", [("link", "a")]),
        ("![x](y) [a[b]](c(d))", [("markdown_image", "![x](y)"), ("text", " "), ("markdown_link", "[a[b]](c(d))")]),
        ("[^1]: t [^1]", [("footnote_def", "[^1]: "), ("text", "t "), ("footnote_ref", "[^1]")]),
        ("`a` ``b` c", [("inline_code", "`a`"), ("text", " `"), ("inline_code", "`b`"), ("text", " c")]),
        ("****a_", [("markdown_emphasis", "***"), ("markdown_emphasis", "*"), ("text", "a"), ("markdown_emphasis", "_")]),
        ("#tag a#b #12 (#c", [("obsidian_tag", "#tag"), ("text", " a#b #12 ("), ("obsidian_tag", "#c")]),
    ],
)
def test_pieces(text, want):
    assert kinds(text) == want


def test_pieces_cover_the_text_and_open_brackets_stay_cheap():
    for text in ("[" * 50_000, "[^" * 30_000, "<a " * 30_000, "`` ` " * 20_000, "\\[" * 30_000, "😀[[wiki/Q1]]\n" * 1000):
        found = list(pieces(text))
        assert [p.start for p in found[1:]] == [p.end for p in found[:-1]] and found[0].start == 0 and found[-1].end == len(text)


def test_links():
    assert entity_path(" \\wiki\\Q5#x", "wiki") == "wiki/Q5.md"
    assert entity_path("wiki/", "wiki") is None and entity_path("other/Q5", "wiki") is None
    assert (percent_decoded("a%20b+c"), percent_decoded("a%2"), percent_decoded("%ff")) == ("a b+c", "a%2", "%ff")
    assert (shown_name("a/b.MD#c"), shown_name("a//")) == ("b", "a")


def test_context():
    assert N.context("a  b") == "a b" and N.context("ab  ") == "ab "
    assert N.context("北" * 20) == "北" * 10
    assert N.context("x" * 29 + "  yz") == "x" * 29 + " y"


WORDS = ["Qora", "ora", "Velm Tor", "Tor", "Ask"]
CANDIDATES = [(0, ["Q1"]), (1, ["Q9"]), (2, ["Q2", "Q3"]), (3, ["Q4"]), (4, ["Q5"])]


@pytest.fixture(scope="module")
def groups(spark):
    notes = spark.createDataFrame([(1, "[[wiki/Q2|Velm Tor]] met Ask.\n\n---\nAsk saw *Ask* Task"), (2, None), (3, "")], "note_id long, text string")
    candidates = spark.createDataFrame(CANDIDATES, "surface_id int, eids array<string>")
    return notes, candidates, N.mention_groups(N.with_candidates(N.note_matches(notes, WORDS), candidates))


def test_mentions_and_conflicts(groups):
    mentions = {(r["source_start"], r["source_end"], r["eid"], r["suspect"]) for r in N.mentions_of(groups[2]).collect()}
    assert mentions == {(25, 28, "Q5", False), (35, 38, "Q5", False), (44, 47, "Q5", False)}
    row = N.conflicts_of(groups[2]).first()
    assert (row["text"], row["source_start"], row["source_end"], row["left_context"], row["right_context"]) == ("Velm Tor", 0, 20, "", " met Ask. ")
    body = {"version": "mention-conflict-v1", "leftContext": "", "text": "Velm Tor", "rightContext": " met Ask. ", "matches": [{"text": "Velm Tor", "surfaceId": 2, "eids": ["Q2", "Q3"]}, {"text": "Tor", "surfaceId": 3, "eids": ["Q4"]}]}
    assert row["hash"] == hashlib.sha256(json.dumps(body, separators=(",", ":")).encode()).hexdigest()
    assert [h["resolved_eid"] for h in row["hits"]] == ["Q2", None]


def test_suspects_leave_conflicts(spark):
    notes = spark.createDataFrame([(1, "Qora Qoras")], "note_id long, text string")
    candidates = spark.createDataFrame(CANDIDATES, "surface_id int, eids array<string>")
    rows = N.conflicts_of(N.mention_groups(N.with_candidates(N.note_matches(notes, WORDS), candidates))).collect()
    assert [[h["surface"] for h in r["hits"]] for r in rows] == [["Qora"]]


def test_rewriting(groups):
    notes, _, found = groups
    wanted = N.replacements(N.mentions_of(found), N.conflict_matches_of(N.conflicts_of(found)))
    got = {r["note_id"]: (r["text"], r["changed"]) for r in N.render_notes(notes, wanted).collect()}
    assert got == {1: ("[[wiki/Q2|Velm Tor]] met [[wiki/Q5|Ask]].\n\n---\n[[wiki/Q5|Ask]] saw *Ask* Task", True), 2: (None, None), 3: ("", False)}


def test_rewriting_drops_links_that_nothing_wants():
    assert N.rewritten("a [[wiki/Q7|b]] [c](d)", []) == "a b [c](d)"
    want = [{"tier": 0, "segment_no": 0, "cluster_no": k, "start": a, "end": b, "text": t, "eid": "Q1", "target": "wiki/Q1"} for k, (a, b, t) in enumerate([(0, 2, "ab"), (1, 3, "bc"), (3, 4, "d")])]
    assert N.rewritten("abcd", want) == "[[wiki/Q1|ab]]cd"


def test_sync_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Ask me")], "note_id long, text string").coalesce(1).write.json(str(tmp_path / "in"))
    candidates = spark.createDataFrame(CANDIDATES, "surface_id int, eids array<string>")
    stream = spark.readStream.schema("note_id long, text string").json(str(tmp_path / "in"))
    run = sync.sync_stream(stream, WORDS, candidates, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out/notes")).select("text").collect()] == ["[[wiki/Q5|Ask]] me"]
    assert spark.read.parquet(str(tmp_path / "out/mentions")).agg(F.count("eid")).first()[0] == 1
    # synced again without a mention: the old one no longer counts
    sync.sync_batch(spark.createDataFrame([(1, "nothing"), (2, "Ask")], "note_id long, text string"), WORDS, candidates, str(tmp_path / "out"), 1)
    assert [r["note_id"] for r in sync.current(spark, str(tmp_path / "out"), "mentions").collect()] == [2]
    assert {(r["note_id"], r["text"]) for r in sync.current(spark, str(tmp_path / "out"), "notes").collect()} == {(1, "nothing"), (2, "[[wiki/Q5|Ask]]")}


def test_matches_are_not_broadcast(spark, sf, monkeypatch):
    """They grow with the notes, whatever the planner thinks of their size; candidates may be broadcast while they are few."""
    rows, candidates = adapters.part_notes(spark, sf)
    found = N.note_matches(rows, adapters.NOTE_WORDS)

    def plan():
        joined = N.with_candidates(found, candidates)
        return joined.count(), joined._jdf.queryExecution().optimizedPlan().toString(), joined._jdf.queryExecution().executedPlan().toString()

    n, _, planned = plan()
    assert "BuildRight" in planned and "BuildLeft" not in planned
    monkeypatch.setattr(N, "MOST_LISTED", 0)
    again, hinted, planned = plan()
    assert again == n > 0 and "strategy=merge" in hinted and "BroadcastHashJoin" not in planned


@pytest.mark.parametrize("seed", range(4))
def test_contexts_of_many_places_equal_those_read_one_by_one(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        text = "".join(rnd.choices("ab山é😀 \n\u3000\u2029", weights=[9, 9, 4, 2, 1, rnd.choice([1, 9]), 2, 1, 1], k=rnd.randint(0, 150)))
        places = list(range(len(text) + 1))
        assert N.Contexts(text).from_places(places) == [N.context(text[p:]) for p in places]
    left, right = N._contexts("x" * 9 + " \n" + "y" * 50, list(range(40)), list(range(40)))
    assert left[30] == "x" * 9 + " " + "y" * 19 and right[0] == "x" * 9 + " " + "y" * 20


def test_contexts_of_a_long_text_take_few_steps(monkeypatch):
    """Many matches in one segment: no context is read character by character."""
    def never(outward):
        raise AssertionError

    monkeypatch.setattr(N, "context", never)
    (run,) = N.segments(pieces("abc " * 1000))
    assert len(list(N.segment_matches(("abc",), run))) == 1000


def test_texts_that_come_again_are_cut_once(spark):
    """The pieces of 3,000 notes of two texts and nulls; the second text is longer than those whose matches are kept."""
    texts = ["a `b` c", None, "x [[wiki/Q1|y]] " * 40]
    rows = spark.createDataFrame([(i, texts[i % 3]) for i in range(3000)], "note_id long, text string").coalesce(1)
    got = N.note_pieces(rows).groupBy("piece_no", "syntax", "text", "start", "end", "eid", "path").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {tuple(r) for r in got} == {(k, *p, 1000) for t in (texts[0], texts[2]) for k, p in enumerate(pieces(t))}
    per = N.note_matches(rows, ["b", "c", "y"]).groupBy("note_id").count().collect()
    assert {(r["note_id"] % 3, r["count"]) for r in per} == {(0, 1), (2, 40)} and len(per) == 2000


def test_small_tables_are_dealt_over_all_cores(spark, sf):
    for rows in (adapters.syntax_notes(spark, sf), adapters.part_notes(spark, sf)[0]):
        assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
