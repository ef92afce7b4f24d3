"""Mentions, conflicts and rewriting over whole documents as notes, against brute force."""

import re

import pytest
import regex

from lexweave.functions.markdown import pieces
from lexweave.operators import notes as N
from lexweave.plans import adapters, catalogue

LINK = re.compile(r"\[\[wiki/(Q\d+)\|([^\]]*)\]\]")


def hits_of(text, words):
    """Every place of every word, by looking at all substrings."""
    return sorted((a, a + n, words[text[a : a + n]]) for n in {len(w) for w in words} for a in range(len(text) - n + 1) if text[a : a + n] in words)


def apart(spans):
    """Of spans (start, end, text) those that overlap none taken before."""
    taken = []
    for s in spans:
        if all(s[1] <= t[0] or t[1] <= s[0] for t in taken):
            taken.append(s)
    return taken


def brute(note, text, words, eids):
    """Mentions, conflicts, and the spans that become links."""
    names = {i: w for w, i in words.items()}
    mentions, conflicts, sure, won, runs, run = set(), set(), [], [], [], []
    for p in [*pieces(text), None]:
        if p and p.syntax in ("text", "link"):
            run.append(p)
        elif run:
            runs.append(run)
            run = []
    for no, run in enumerate(runs):
        shown = "".join(p.text for p in run)
        place = [(p.start, p.end, p) if p.syntax == "link" else (p.start + k, p.start + k + 1, p) for p in run for k in range(len(p.text))]
        edges = {m.start() for m in regex.finditer(r"\b", shown, regex.WORD)} | {0, len(shown)}
        clusters = []
        for h in hits_of(shown, words):
            if clusters and h[0] < max(e for _, e, _ in clusters[-1]):
                clusters[-1].append(h)
            else:
                clusters.append([h])
        for k, found in enumerate(clusters, 1):
            def known(a, b, i):
                first, last = place[a][2], place[b - 1][2]
                return first.eid if first is last and first.syntax == "link" and first.eid in eids[i] else None

            a, b = found[0][0], max(e for _, e, _ in found)
            suspect = {h: not {h[0], h[1]} <= edges for h in found}
            ends = (place[a][0], max(place[e - 1][1] for _, e, _ in found))
            if len(found) == 1 and len(eids[found[0][2]]) == 1:
                i = found[0][2]
                mentions.add((note, no, k, shown[a:b], eids[i][0], i, *ends, suspect[found[0]], known(*found[0]) == eids[i][0]))
                if not suspect[found[0]] or known(*found[0]):
                    sure.append((*ends, shown[a:b]))
            elif kept := [h for h in found if known(*h) or not suspect[h]]:
                conflicts.add((note, no, k, shown[a:b], *ends, "|".join(names[i] for *_, i in kept)))
                won += apart([(place[h[0]][0], place[h[1] - 1][1], names[h[2]]) for h in kept if known(*h)])
    return mentions, conflicts, apart(sure + won)


@pytest.fixture(scope="module")
def case(spark, sf):
    rows, candidates = adapters.document_notes(spark, sf)
    words = {w: i for i, w in enumerate(adapters.dictionary_words(spark, sf))}
    eids = {r["surface_id"]: r["eids"] for r in candidates.collect()}
    return {r["note_id"]: r["text"] for r in rows.collect()}, words, eids


def test_mentions_and_conflicts_over_documents(spark, sf, case):
    texts, words, eids = case
    mentions, conflicts = set(), set()
    for note, text in texts.items():
        some, others, _ = brute(note, text or "", words, eids)
        mentions |= some
        conflicts |= others
    assert len(mentions) > 1000 and len(conflicts) > 1000 and any(m[-1] for m in mentions)
    got = catalogue.queries()["document_mentions"](spark, sf).collect()
    assert len(got) == len(mentions) and {tuple(r) for r in got} == mentions
    found = catalogue.queries()["document_conflicts"](spark, sf).collect()
    assert len(found) == len(conflicts)
    assert {(r["note_id"], r["segment_no"], r["cluster_no"], r["text"], r["source_start"], r["source_end"], r["surfaces"]) for r in found} == conflicts


def test_rewriting_over_documents(spark, sf, case):
    """Wanted spans show their text (one within an old link stands for all of it), all else stays but old links."""
    texts, words, eids = case
    out = {r["note_id"]: r["text"] for r in catalogue.queries()["document_rewriting"](spark, sf).collect()}
    assert set(out) == set(texts)
    links = 0
    for note, text in out.items():
        old, want, at = texts[note] or "", "", 0
        for start, end, shown in sorted(brute(note, old, words, eids)[2]):
            want += LINK.sub(r"\2", old[at:start]) + shown
            at = end
        assert LINK.sub(r"\2", text or "") == want + LINK.sub(r"\2", old[at:])
        section = []
        for p in pieces(text or ""):
            section = [] if p.syntax == "thematic_break" else section
            if p.syntax == "link":
                assert p.eid not in section
                section.append(p.eid)
                links += 1
    assert links > len(texts)
    again = N.rewritten(next(t for t in texts.values() if t), [])
    assert not LINK.search(again)


def test_word_edges_equal_all_boundaries():
    import random

    import numpy as np

    rng = random.Random(3)
    parts = ["a", "é", "ª", "µ", "×", "ÿ", " ", "\n", "́", "‍", "'", ".", ",", "1", "_", "北", "京", "😀", "🇦", " ", "\xa0", "\r", "Я", "ß"]
    for n in range(400):
        text = "".join(rng.choices(parts, k=n % 40 + 1))
        want = {0, len(text)} | {m.start() for m in N.WORD_EDGE.finditer(text)}
        assert set(N.word_edges(text, np.arange(len(text) + 1)).tolist()) == want


def test_groups_made_while_scanning_equal_those_of_joined_matches(spark, sf, monkeypatch):
    """The same rows, with hashes, whether candidates go to the workers or are joined; the first way shuffles no match."""
    rows, candidates = adapters.document_notes(spark, sf)
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "北京 tor velm torr x́tor [[wiki/Q1|tor]]\n***\ntor")], "note_id long, text string")
    rows = rows.filter("note_id % 20 = 0").unionByName(extra)
    words = [*adapters.dictionary_words(spark, sf), "tor", "velm tor", "tor", "北京", "", "never"]
    n = len(words)
    more = spark.createDataFrame([(n - 6, ["Q1"]), (n - 5, ["Q2", "Q1"]), (n - 4, ["Q3"]), (n - 3, ["Q4"]), (n - 2, ["Q5"]), (n - 1, []), (n + 7, ["Q9"])], "surface_id int, eids array<string>")
    candidates = candidates.unionByName(more)
    fast = N.note_groups(rows, words, candidates)
    assert "Exchange" not in fast._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    monkeypatch.setattr(N, "MOST_LISTED", 0)
    slow = N.note_groups(rows, words, candidates)
    assert "hash" in fast.columns and "hash" not in slow.columns
    for of in (N.mentions_of, N.conflicts_of):
        columns = of(slow).columns
        got, want = ([repr(r) for r in of(g).select(columns).collect()] for g in (fast, slow))
        assert sorted(got) == sorted(want) and len(want) > 50
    wanted = N.replacements(N.mentions_of(slow), N.conflict_matches_of(N.conflicts_of(slow)))
    assert sorted(map(repr, N.linked(fast).collect())) == sorted(map(repr, wanted.collect()))
