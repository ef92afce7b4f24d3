"""Matches over chunks: all kinds equal the whole-text results, states end."""

import random
import time

import pytest

from lexweave.operators import matching
from lexweave.streaming import chunks

SCHEMA = "note_id long, chunk_no long, text string, last boolean"


def run(spark, tmp_path, patterns, kind="overlapping", timeout_ms=None):
    """Stream the files that are there, one a batch; the last progress report."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    sink = chunks.chunk_matches(stream, patterns, kind, timeout_ms).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    query = sink.outputMode("append").trigger(availableNow=True).start()
    if timeout_ms is None:
        assert query.awaitTermination(120)
    else:  # with timers it goes on with batches without data
        until = time.time() + 60
        while time.time() < until and query.isActive and not (query.lastProgress and query.lastProgress["numInputRows"] == 0):
            time.sleep(0.2)
        query.stop()
    assert query.exception() is None
    return query.lastProgress


def put(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / name))


def found(spark, tmp_path):
    rows = spark.read.schema(chunks.MATCH).parquet(str(tmp_path / "out")).collect()
    return sorted(tuple(r) for r in rows)


def whole(texts, patterns, kind):
    """Matches of whole texts, positions in code points, bytes and UTF-16 units."""
    out = []
    for note, text in texts.items():
        for a, b, i in matching.find(tuple(patterns), text, kind):
            size = [(len(text[:k].encode()), len(text[:k].encode("utf-16-le")) // 2) for k in (a, b)]
            out.append((note, a, b, i, patterns[i], size[0][0], size[1][0], size[0][1], size[1][1]))
    return sorted(out)


@pytest.mark.parametrize("kind", matching.KINDS)
def test_kinds_equal_whole_texts_at_random_cuts(spark, tmp_path, kind):
    rnd = random.Random(kind)
    patterns = list(dict.fromkeys("".join(rnd.choices("aé山😀", k=rnd.randint(1, 5))) for _ in range(14)))
    texts = {n: "".join(rnd.choices("aé山😀x", weights=[5, 5, 5, 5, 1], k=rnd.randint(0, 60))) for n in range(30)}
    files = [[] for _ in range(2)]
    for n, text in texts.items():
        cuts = sorted(rnd.choices(range(len(text) + 1), k=rnd.randint(0, 8)))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        rows = [(n, k, part, k == len(parts) - 1) for k, part in enumerate(parts)]
        rnd.shuffle(rows)
        for row in rows + rows[:1]:  # out of order, and one twice
            files[rnd.randint(0, 1) if row is not rows[0] else 0].append(row)
    for k, rows in enumerate(files):
        put(spark, tmp_path, f"f{k}", rows)
    last = run(spark, tmp_path, patterns, kind)
    want = whole(texts, patterns, kind)
    assert len(want) > 50
    assert set(found(spark, tmp_path)) == set(want)


def test_state_ends_with_the_mark_or_the_timeout(spark, tmp_path):
    words, hour = ["ab", "abc", "bcd"], 3_600_000
    put(spark, tmp_path, "a", [(1, 0, "xa", False), (1, 1, "b", True), (2, 0, "a", False), (2, 1, "b", False), (2, 7, "never read", False)])
    progress = run(spark, tmp_path, words, "leftmost_longest", hour)
    assert [r[:4] for r in found(spark, tmp_path)] == [(1, 1, 3, 0)]  # text 2 may still go on to "abc"
    assert progress["stateOperators"][0]["numRowsTotal"] > 0
    # from its next chunk on text 2 has a millisecond only
    put(spark, tmp_path, "b", [(2, 8, "nor this", False)])
    run(spark, tmp_path, words, "leftmost_longest", 1)
    # late chunks: 2 is gone, so its chunk 2 waits in vain, and chunk 0 of text 1 begins a new one
    put(spark, tmp_path, "c", [(2, 2, "cd", False), (1, 0, "bcd", True)])
    run(spark, tmp_path, words, "leftmost_longest", 1)
    put(spark, tmp_path, "d", [(9, 0, "q", True)])
    progress = run(spark, tmp_path, words, "leftmost_longest", 1)
    assert [r[:4] for r in found(spark, tmp_path)] == [(1, 0, 3, 2), (1, 1, 3, 0), (2, 0, 2, 0)]
    assert progress["stateOperators"][0]["numRowsTotal"] == 0


def test_unknown_kind_is_an_error(spark):
    with pytest.raises(ValueError):
        chunks.chunk_matches(spark.createDataFrame([], SCHEMA), ["a"], "other")


def test_many_texts_share_a_call(spark, tmp_path, monkeypatch):
    """Calls by bucket, not by text; null, large and negative ids are texts of their own."""
    monkeypatch.setattr(chunks, "BUCKETS", 2)
    ids = [None, 2**62 + 1, -3, *range(50)]
    put(spark, tmp_path, "a", [(n, 0, "xa", False) for n in ids])
    put(spark, tmp_path, "b", [(n, 1, "b", n != 7) for n in ids])
    progress = run(spark, tmp_path, ["ab"])
    got = spark.read.schema(chunks.MATCH).parquet(str(tmp_path / "out")).collect()
    assert sorted((r["note_id"] is None, r["note_id"] or 0, r["start"]) for r in got) == sorted((n is None, n or 0, 1) for n in ids)
    assert progress["stateOperators"][0]["numRowsTotal"] == 1  # text 7 goes on
