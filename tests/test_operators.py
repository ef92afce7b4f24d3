import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import matching as M
from lexweave.operators import mentions, policy
from lexweave.sources import dumps

def occurrences(patterns, text):
    """Every place of every pattern, the empty one at each boundary; by end, longer ones first, then as registered."""
    found = [(a, a + len(p), i) for i, p in enumerate(patterns) for a in range(len(text) + 1) if text[a : a + len(p)] == p and a + len(p) <= len(text)]
    return sorted(found, key=lambda h: (h[1], h[0], h[2]))


def chosen(hits, order):
    """One by one the best hit in `order` that begins where the last one ends or later."""
    taken = []
    while left := [h for h in hits if not taken or h[0] >= taken[-1][1]]:
        taken.append(min(left, key=order))
    return taken


def leftmost(hits, best):
    """Each place has one hit, the best there; a place within the last hit gives none, nor an empty one right at its end."""
    taken = []
    for start in sorted({h[0] for h in hits}):
        h = min((h for h in hits if h[0] == start), key=best)
        if not taken or start > taken[-1][1] or (start == taken[-1][1] and h[1] > start):
            taken.append(h)
    return taken


def wanted(patterns, text, kind):
    hits = occurrences(patterns, text)
    if kind == "overlapping":
        return hits
    if kind == "longest_per_end":
        return [h for k, h in enumerate(hits) if not k or hits[k - 1][1] != h[1]]
    if kind == "nonoverlap":
        if "" in patterns:  # it ends before any other does, everywhere
            return [(k, k, patterns.index("")) for k in range(len(text) + 1)]
        return chosen(hits, lambda h: (h[1], h[0], h[2]))
    return leftmost(hits, {"leftmost_longest": lambda h: (-h[1], h[2]), "leftmost_first": lambda h: h[2]}[kind])


@pytest.mark.parametrize("kind", M.KINDS)
@pytest.mark.parametrize("alphabet", ["ab", "aé山😀"])
@pytest.mark.parametrize("shortest", [0, 1])
def test_match_kinds_equal_brute_force(kind, alphabet, shortest):
    """Random patterns and texts; with `shortest` 0 the empty pattern is among most sets."""
    rnd = random.Random(f"{kind}{alphabet}{shortest}")
    for _ in range(250):
        patterns = tuple(dict.fromkeys("".join(rnd.choices(alphabet, k=rnd.randint(shortest, 4))) for _ in range(rnd.randint(0, 6))))
        text = "".join(rnd.choices(alphabet + "x", k=rnd.randint(0, 12)))
        assert list(M.find(patterns, text, kind)) == wanted(patterns, text, kind), (patterns, text)


def test_unknown_kind_is_an_error():
    with pytest.raises(ValueError):
        M.find(("a",), "a", "other")


POLICY = [(1, [(15, 1)], False), (0, [(6, 1)], True), (0, [], False), (0, [(1, 2)], True), (0, [(1, 0)], True), (0, [(6, 1), (16, 1)], False), (0, [(6, 1), (18, 1)], True), (0, [(1, 5), (18, 1), (19, 2)], False), (0, [(1, 2), (18, 2)], False), (0, [(1, 2), (18, 3)], True), (0, [(0, 0), (1, 5), (22, 2)], True)]


def test_policy(spark):
    rows = spark.createDataFrame([(i, f, c) for i, (f, c, _) in enumerate(POLICY)], "i int, flags int, colors array<struct<anchor_id:int,distance:int>>")
    got = {r["i"]: r["r"] for r in rows.select("i", policy.should_report(F.col("flags"), F.col("colors")).alias("r")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(POLICY)}


def test_dump_tuples():
    line = r"INSERT INTO `page` VALUES (1,0,'Foo_Bar',''),(2,4,'Talk',''),(3,0,'It\'s',NULL);"
    assert dumps.parse_tuples(line) == [["1", "0", "Foo_Bar", ""], ["2", "4", "Talk", ""], ["3", "0", "It's", ""]]
    with pytest.raises(ValueError):
        dumps.parse_tuples("INSERT INTO `page` VALUES (1,0")


def test_text_functions(spark):
    row = spark.createDataFrame([("_Foo_Bar　", "a😀北", "a\\q\\\\n\\", "Q4294967296", "Q7")], "t string, u string, e string, big string, q string")
    got = row.select(T.surface_key(F.col("t")), T.utf16_length(F.col("u")), T.unescape_tsv(F.col("e")), T.qid_number(F.col("big")), T.qid_number(F.col("q"))).first()
    assert tuple(got) == ("Foo Bar", 4, "a\\q\\n\\", None, 7)


def test_tied_matches_are_in_one_cluster(spark):
    """Rows that share note, start, end and surface differ in candidates only; each cluster holds all of them."""
    rows = [(1, 0, 5, 1, 1)] + [(1, 10, 13, 4, n) for n in (1, 2, 1, 2)] + [(1, 12, 15, 2, 1), (1, 15, 17, 2, 2), (1, 15, 17, 2, 1)]
    got = mentions.clusters(spark.createDataFrame(rows, "note_id long, start int, end int, surface_id int, n_qids int")).collect()
    assert sorted((r["start"], r["cluster_no"]) for r in got) == [(0, 1), (10, 2), (10, 2), (10, 2), (10, 2), (12, 2), (15, 3), (15, 3)]
