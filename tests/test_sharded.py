"""Dictionaries beyond a broadcast, against the broadcast scan and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.operators import matching, sharded

KINDS = ("overlapping", "longest_per_end", "nonoverlap", "leftmost_longest", "leftmost_first")


def case(seed):
    rnd = random.Random(seed)
    word = lambda lo, hi: "".join(rnd.choices("aé山😀 ", k=rnd.randint(lo, hi)))
    long = [word(9, 120) for _ in range(12)]
    patterns = list(dict.fromkeys([word(1, 9) for _ in range(30)] + long + [w[5:60] for w in long] + ["never there", "x" * 300]))
    texts = [(i, "".join(rnd.choice([word(0, 12), rnd.choice(patterns), rnd.choice(long)]) for _ in range(rnd.randint(0, 12)))) for i in range(40)]
    return patterns, texts + [(900, None), (901, ""), (902, "山" * 3000), (902 + 1, "x" * 299)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("kind", KINDS)
def test_sharded_equals_broadcast(spark, monkeypatch, kind):
    monkeypatch.setattr(sharded, "CODES_AT_ONCE", 50)
    monkeypatch.setattr(sharded, "HOT_SHARE", 20)
    patterns, texts = case(kind)
    notes = spark.createDataFrame(texts, "doc long, body string").repartition(3)
    dictionary = spark.createDataFrame(list(enumerate(patterns)), "surface_id long, pattern string").repartition(3)
    want = rows_of(matching.match_dictionary(notes, patterns, "doc", "body", kind))
    assert len(want) > 100
    assert rows_of(sharded.match_sharded(notes, dictionary, "doc", "body", kind)) == want


def test_two_texts_of_one_id_and_repeated_rows(spark):
    pattern = "the beginning of a long pattern that goes on and on beyond what is sent along with a gram"
    texts = [(1, pattern), (1, pattern[:70] + "!"), (1, pattern), (2, "a"), (2, "a")]
    notes = spark.createDataFrame(texts, "doc long, body string")
    got = rows_of(sharded.match_sharded(notes, spark.createDataFrame([(0, pattern), (1, "a"), (2, "a")], "surface_id long, pattern string"), "doc", "body"))
    assert [r for r in got if r[3] == 0] == [(1, 0, len(pattern), 0, pattern)] * 2
    assert len([r for r in got if r[0] == 2]) == 4


def test_beyond_the_limit_the_dictionary_is_sharded(spark, monkeypatch):
    """The same matches come from both ways; the driver fetches no pattern on the way beyond the limit."""
    notes = spark.createDataFrame([(1, "Velm Tor met Ask"), (2, "asking Tor")], "doc long, body string")
    lists = spark.createDataFrame([("Tor", [1, 2]), ("Velm Tor", [3]), ("Ask", [4]), ("none", [])], "surface_key string, qids array<long>")
    want = rows_of(matching.match_surfaces(notes, lists, None, "doc", "body"))
    monkeypatch.setattr(matching, "MOST_CHARACTERS", 5)
    with pytest.raises(ValueError):
        matching.collect_patterns(lists.withColumnRenamed("surface_key", "pattern").withColumn("surface_id", F.lit(0)))
    assert rows_of(matching.match_surfaces(notes, lists, None, "doc", "body")) == want and len(want) == 4
    words = spark.createDataFrame([(0, "Tor"), (1, "Ask"), (2, "zzz")], "surface_id long, pattern string")
    assert rows_of(matching.count_matches(notes, words, "doc", "body")) == [("Ask", 1, 1), ("Tor", 2, 2)]


def test_empty_tables_and_patterns(spark):
    notes = spark.createDataFrame([(1, "a")], "doc long, body string")
    none = spark.createDataFrame([], "surface_id long, pattern string")
    assert rows_of(sharded.match_sharded(notes, none, "doc", "body")) == []
    assert rows_of(sharded.match_sharded(notes.limit(0), spark.createDataFrame([(0, "a")], none.schema), "doc", "body")) == []
    with pytest.raises(ValueError):
        sharded.match_sharded(notes, spark.createDataFrame([(0, "")], none.schema), "doc", "body").collect()
    with pytest.raises(ValueError):
        sharded.match_sharded(notes, spark.createDataFrame([(0, "a")], none.schema), "doc", "body", "other")


def test_places_carry_what_patterns_reach_only(spark):
    """A pattern no longer than its gram needs nothing around it; of longer ones the reach by size decides."""
    words = spark.createDataFrame([(0, "abcd"), (1, "abcdefghij"), (2, "wxyzwxyz" + "q" * 60)], "surface_id long, pattern string")
    anchors = sharded._anchored(words, sharded.np.zeros(sharded.BUCKETS, sharded.np.int64))
    reach = sharded._reach(anchors)
    assert reach == {4: (0, 0), 8: (0, sharded.AROUND)}
    notes = spark.createDataFrame([(1, "--abcd--" + "x" * 100)], "note_id long, text string")
    (place,) = sharded._places(notes, sharded._bitmap(anchors), reach).collect()
    assert (place["at"], place["left"], place["around"]) == (2, 0, "abcd")


def nowhere(*_):
    raise AssertionError("places were sent on")


@pytest.mark.parametrize("kind", KINDS)
def test_groups_with_few_patterns_send_no_places(spark, monkeypatch, kind):
    """Neither places nor matches are shuffled where a group of texts can hold the patterns that may occur in it."""
    monkeypatch.setattr(sharded, "GROUP_CODES", 500, raising=False)
    monkeypatch.setattr(sharded, "_places", nowhere)
    monkeypatch.setattr(sharded, "_greedy", nowhere)
    patterns, texts = case(kind)
    notes = spark.createDataFrame(texts, "doc long, body string").repartition(3)
    dictionary = spark.createDataFrame(list(enumerate(patterns)), "surface_id long, pattern string").repartition(3)
    want = rows_of(matching.match_dictionary(notes, patterns, "doc", "body", kind))
    assert rows_of(sharded.match_sharded(notes, dictionary, "doc", "body", kind)) == want and len(want) > 100


def test_each_group_gets_its_own_patterns_only(spark, monkeypatch):
    listed = []
    scan = sharded._scan_groups
    monkeypatch.setattr(sharded, "_scan_groups", lambda rows, kind: (listed.extend(rows.filter("NOT of_note").select("part", "text").collect()), scan(rows, kind))[1])
    notes = spark.createDataFrame([(k, f"here is word{k} alone") for k in range(40)], "doc long, body string")
    dictionary = spark.createDataFrame([(k, f"word{k} alone") for k in range(200)], "surface_id long, pattern string")
    got = rows_of(sharded.match_sharded(notes, dictionary, "doc", "body", "leftmost_longest"))
    assert [(r[0], r[3]) for r in got] == [(k, k) for k in range(40)]
    assert len({r["part"] for r in listed}) > 1 and len(listed) == len(set(listed))
    assert {r["text"] for r in listed} == {f"word{k} alone" for k in range(40)} and len(listed) == 40


@pytest.mark.parametrize("kind", ["overlapping", "longest_per_end", "leftmost_longest"])
def test_full_groups_go_by_places_beside_the_others(spark, monkeypatch, kind):
    patterns, texts = case(kind)
    notes = spark.createDataFrame(texts, "doc long, body string").repartition(3)
    dictionary = spark.createDataFrame(list(enumerate(patterns)), "surface_id long, pattern string").repartition(3)
    want = rows_of(matching.match_dictionary(notes, patterns, "doc", "body", kind))
    sent, places = [], sharded._places
    monkeypatch.setattr(sharded, "_places", lambda notes, *rest: (sent.append(notes.count()), places(notes, *rest))[1])
    monkeypatch.setattr(sharded, "GROUP_CODES", 500)
    for most in (0, 400):
        monkeypatch.setattr(sharded, "GROUP_PATTERNS", most)
        assert rows_of(sharded.match_sharded(notes, dictionary, "doc", "body", kind)) == want
    assert len(sent) == 2 and 0 < sent[1] < sent[0]


@pytest.mark.parametrize("kind", ["longest_per_end", "nonoverlap", "leftmost_longest", "leftmost_first"])
def test_rows_of_one_id_are_one_text(spark, monkeypatch, kind):
    """Hits of all rows of an id, null too, are chosen from together, in groups and by places."""
    words = ["ab", "b", "bab", "abc", "the beginning of a long pattern that goes on beyond what is sent", "abc"]
    texts = [(1, "abab"), (1, "xbabc"), (1, "abab"), (2, "abc"), (None, "b" + words[4]), (None, "abc"), (3, None), (3, "")]
    hits = [(k, a, b, i, words[i]) for k, t in texts for a, b, i in matching.overlapping(tuple(words), t or "")]
    order = {"longest_per_end": lambda h: (h[2], h[1], h[3]), "nonoverlap": lambda h: (h[2], h[1], h[3]), "leftmost_longest": lambda h: (h[1], -h[2], h[3]), "leftmost_first": lambda h: (h[1], h[3])}[kind]
    want = []
    for key in (1, 2, None):
        at, ends = 0, set()
        for h in sorted((h for h in hits if h[0] == key), key=order):
            if h[2] not in ends if kind == "longest_per_end" else h[1] >= at:
                want.append(h)
                at = h[2]
                ends.add(h[2])
    notes = spark.createDataFrame(texts, "doc long, body string")
    dictionary = spark.createDataFrame(list(enumerate(words)), "surface_id long, pattern string")
    for most in (1 << 20, 0):
        monkeypatch.setattr(sharded, "GROUP_PATTERNS", most)
        got = [tuple(r) for r in sharded.match_sharded(notes, dictionary, "doc", "body", kind).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("kind", KINDS)
def test_matches_of_many_texts_at_once(monkeypatch, kind):
    """By arrays, by few hits at a time, and hit by hit, against the folds of single texts."""
    rnd = random.Random(kind)
    for at_once in (50_000, 7, 1):
        monkeypatch.setattr(sharded, "ROWS_AT_ONCE", at_once)
        for _ in range(60):
            patterns = tuple("".join(rnd.choices("aé山", k=rnd.randint(1, 4))) for _ in range(rnd.randint(0, 7)))
            texts = ["".join(rnd.choices("aé山😀", k=rnd.randint(0, 25))) for _ in range(rnd.randint(0, 6))] + [None]
            got = sorted((int(k), int(a), int(b), int(i)) for part in sharded.Scan(patterns, kind)(texts) for k, a, b, i in zip(*part, strict=True))
            assert got == sorted((k, *h) for k, t in enumerate(texts) for h in matching.find(patterns, t or "", kind)), (patterns, texts)


def test_stretches_hold_every_window(monkeypatch):
    monkeypatch.setattr(sharded, "CODES_AT_ONCE", 10)
    texts = ["abcdefgh" * 5, None, "", "xy", "0123456789", "é山😀" * 9]
    for sizes in ([3], [1, 2, 5]):
        seen = {n: set() for n in sizes}
        for codes in sharded._stretches(texts, max(sizes)):
            assert len(codes) <= 2 * (10 + max(sizes))
            for n, hashes in sharded.sized_hashes(codes, sizes):
                seen[n] |= set(hashes.tolist())
        for n in sizes:
            assert seen[n] >= {int(h) for t in texts if t for h in sharded.gram_hashes(sharded._codes(t), n)}
