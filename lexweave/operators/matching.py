"""Dictionary matching over texts: one automaton scan a worker, match kinds as folds over its hits.

A dictionary of MOST_CHARACTERS at most is broadcast; larger ones go the way of operators/sharded.py. Positions are
code points. An overlapping scan lists all hits by end, longer ones first, then in order of registration.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators.policy import filter_candidates
from lexweave.operators.sharded import match_sharded
from lexweave.operators.surfaces import dense_ids
from lexweave.session import beside, ship
from lexweave.staging import stage

KINDS = ("overlapping", "longest_per_end", "nonoverlap", "leftmost_longest", "leftmost_first")
Hit = tuple[int, int, int]
MOST_CHARACTERS, ROWS_AT_ONCE = 50_000_000, 50_000
MOST_REPEATED = 1_000_000  # repeated ids of notes that all workers know


_LAST: list[tuple] = [((), None)]


def _automaton(patterns: tuple[str, ...]):
    """The automaton, and the numbers of the empty pattern; that of the tuple asked for last comes without hashing all of it."""
    last, made = _LAST[0]
    if last is not patterns or made is None:
        made = _built(patterns)
        _LAST[0] = (patterns, made)
    return made


@lru_cache(maxsize=4)
def _built(patterns: tuple[str, ...]):
    by_text: dict[str, list[int]] = {}
    for i, p in enumerate(patterns):
        by_text.setdefault(p, []).append(i)
    found = ahocorasick.Automaton()
    for p, ids in by_text.items():
        if p:
            found.add_word(p, (len(p), tuple(ids)))
    if len(found):
        found.make_automaton()
    return found, tuple(by_text.get("", ()))


def _scanned(patterns: tuple[str, ...], text: str) -> Iterator[Hit]:
    """Occurrences of the patterns that aren't empty, by end, longer ones first, then as registered."""
    scan, _ = _automaton(patterns)
    if len(scan):
        for end, (n, ids) in scan.iter(text):
            for i in ids:
                yield end + 1 - n, end + 1, i


def overlapping(patterns: tuple[str, ...], text: str) -> Iterable[Hit]:
    """Every occurrence; an empty pattern occurs at every boundary."""
    _, empty = _automaton(patterns)
    if not empty:
        return _scanned(patterns, text)
    hits = [*_scanned(patterns, text), *((k, k, i) for k in range(len(text) + 1) for i in empty)]
    return sorted(hits, key=lambda h: (h[1], h[0] - h[1], h[2]))


def longest_per_end(patterns: tuple[str, ...], text: str) -> Iterator[Hit]:
    last = -1
    for h in overlapping(patterns, text):
        if h[1] != last:
            last = h[1]
            yield h


def nonoverlap(patterns: tuple[str, ...], text: str) -> Iterator[Hit]:
    """At the first end reached the longest hit since the last one, then on from there; an empty pattern wins everywhere."""
    if "" in patterns:
        yield from ((k, k, patterns.index("")) for k in range(len(text) + 1))
        return
    at = 0
    for h in _scanned(patterns, text):
        if h[0] >= at:
            yield h
            at = h[1]


class Leftmost:
    """At the leftmost start the longest pattern, or the one registered first; then on after it.

    Hits come by end. The best one of a start is sure once all hits that begin there have come; settle() gives those
    before a place, in order. Only starts that aren't settled yet are held; hits may carry more than three fields.
    """

    def __init__(self, first: bool, at: int = 0, any_yet: bool = False, held: Iterable[tuple] = ()) -> None:
        self.better = (lambda h: h[2]) if first else (lambda h: (h[0] - h[1], h[2]))
        self.at, self.any_yet, self.best = at, any_yet, {h[0]: h for h in held}

    def add(self, h: tuple) -> None:
        if h[0] >= self.at and (h[0] not in self.best or self.better(h) < self.better(self.best[h[0]])):
            self.best[h[0]] = h

    def settle(self, upto: int) -> Iterator[tuple]:
        for start in sorted(s for s in self.best if s < upto):
            h = self.best.pop(start)
            if start < self.at or (h[0] == h[1] == self.at and self.any_yet):  # an empty hit right after a hit is skipped
                continue
            yield h
            self.at, self.any_yet = h[1], True


def leftmost(patterns: tuple[str, ...], text: str, first: bool) -> Iterator[Hit]:
    widest = max(map(len, patterns), default=0)
    fold, due = Leftmost(first), widest
    for h in overlapping(patterns, text):
        if h[1] >= due:
            yield from fold.settle(h[1] - widest)
            due = h[1] + widest
        fold.add(h)
    yield from fold.settle(len(text) + 1)


def find(patterns: tuple[str, ...], text: str, kind: str) -> Iterable[Hit]:
    if kind not in KINDS:
        raise ValueError(f"match kind must be one of {KINDS}")
    if kind.startswith("leftmost"):
        return leftmost(patterns, text, kind == "leftmost_first")
    return {"overlapping": overlapping, "longest_per_end": longest_per_end, "nonoverlap": nonoverlap}[kind](patterns, text)


class Units:
    """Positions of a text in UTF-8 bytes and UTF-16 units, from those in code points."""

    def __init__(self, text: str) -> None:
        self.same = text.isascii()
        if not self.same:
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            wide = codes > 0xFFFF
            sizes = (1 + (codes > 0x7F) + (codes > 0x7FF) + wide, 1 + wide)
            self.sums = [np.concatenate([[0], np.cumsum(x)]) for x in sizes]
            self.maps = None

    def __call__(self, start: int, end: int) -> tuple[int, int, int, int]:
        """start and end in bytes, then in UTF-16 units."""
        if self.same:
            return start, end, start, end
        if self.maps is None:
            self.maps = [m.tolist() for m in self.sums]
        return tuple(m[k] for m in self.maps for k in (start, end))

    def many(self, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The same for many positions."""
        return [starts, ends, starts, ends] if self.same else [m[k] for m in self.sums for k in (starts, ends)]


def check_size(patterns: list[str], most: int | None = None) -> None:
    """The bound of what is broadcast, in characters."""
    if sum(map(len, patterns)) > (MOST_CHARACTERS if most is None else most):
        raise ValueError("the dictionary is too large to broadcast")


def fits(dictionary: DataFrame, most: int | None = None) -> bool:
    """Whether (surface_id, pattern) may be broadcast."""
    return (dictionary.agg(F.sum(F.length("pattern")).alias("n")).first()["n"] or 0) <= (MOST_CHARACTERS if most is None else most)


def collect_patterns(dictionary: DataFrame, most: int | None = None) -> list[str]:
    """The patterns of (surface_id, pattern) in order of their dense ids; their size is checked before they are fetched."""
    if not fits(dictionary, most):
        raise ValueError("the dictionary is too large to broadcast")
    return [r["pattern"] for r in dictionary.orderBy("surface_id").select("pattern").collect()]


def hit_arrays(patterns: tuple[str, ...], texts: list[str | None], kind: str) -> Iterator[tuple[np.ndarray, ...]]:
    """(number of the text, start, end, surface id) of the hits in `texts` as arrays of some ROWS_AT_ONCE rows."""
    parts, numbers, held = [], [], 0
    for k, t in enumerate(texts):
        flat = chain.from_iterable(find(patterns, t or "", kind))
        while len(some := np.fromiter(islice(flat, 3 * ROWS_AT_ONCE), np.int64)):
            parts.append(some)
            numbers.append(k)
            held += len(some) // 3
            if held >= ROWS_AT_ONCE:
                yield (np.repeat(numbers, [len(p) // 3 for p in parts]), *np.concatenate(parts).reshape(-1, 3).T)
                parts, numbers, held = [], [], 0
    if parts:
        yield (np.repeat(numbers, [len(p) // 3 for p in parts]), *np.concatenate(parts).reshape(-1, 3).T)


def match_dictionary(notes: DataFrame, patterns: list[str], id_col: str, text: str, kind: str = "overlapping", max_dictionary: int | None = None, units: bool = False) -> DataFrame:
    """(note_id, start, end, surface_id, surface) for every match; surface_id is the pattern's position.

    With `units`, also start_byte, end_byte, start_utf16 and end_utf16, from one map a text.
    """
    check_size(patterns, max_dictionary)
    ship(notes.sparkSession)
    shared = notes.sparkSession.sparkContext.broadcast(tuple(patterns))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        surfaces = pa.array(words, pa.string())
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for k, start, end, i in hit_arrays(words, texts, kind):
                found = [ids.take(pa.array(k)), start, end, i, surfaces.take(pa.array(i))]
                if units:
                    cuts = np.nonzero(np.diff(k, prepend=-1))[0].tolist()  # hits come text by text
                    parts = [Units(texts[k[a]] or "").many(start[a:b], end[a:b]) for a, b in zip(cuts, [*cuts[1:], len(k)], strict=True)]
                    found += [np.concatenate(c) for c in zip(*parts, strict=True)]
                kinds = [pa.int64(), *[pa.int32()] * 3, pa.string(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([f if isinstance(f, pa.Array) else pa.array(f).cast(t) for f, t in zip(found, kinds)], columns)

    schema = "note_id long, start int, end int, surface_id int, surface string" + (", start_byte long, end_byte long, start_utf16 long, end_utf16 long" if units else "")
    columns = [c.split()[0] for c in schema.split(", ")]
    rows = notes.select(F.col(id_col).cast("bigint").alias("note_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, schema)


def count_matches(notes: DataFrame, dictionary: DataFrame, id_col: str, text: str, kind: str = "overlapping") -> DataFrame:
    """(surface, n, notes) of each pattern of `dictionary` (surface_id, pattern) that occurs: matches, and notes that hold one.

    Matches are counted while notes are scanned: those of ids that come once are summed on the spot, those of repeated ids
    go on as a row an id and pattern. Texts of the patterns are joined to the sums only.
    """
    if not fits(dictionary):
        found = match_sharded(notes, dictionary, id_col, text, kind).groupBy("surface_id", "note_id").agg(F.count(F.lit(1)).alias("n"))
        return _summed(found, dictionary)
    patterns = collect_patterns(dictionary)
    ship(notes.sparkSession)
    rows = notes.select(F.col(id_col).cast("bigint").alias("note_id"), F.col(text).alias("text"))
    again = rows.groupBy("note_id").count().filter((F.col("count") > 1) & F.col("note_id").isNotNull()).select("note_id")
    n_again = again.count()
    few = n_again <= MOST_REPEATED
    ids = np.array(sorted(r["note_id"] for r in again.collect()) if few else [], np.int64)
    shared = notes.sparkSession.sparkContext.broadcast((tuple(patterns), ids))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = shared.value
        for batch in batches:
            named = np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(0).is_valid())
            apart = np.isin(named[0], ids) & named[1] if few else named[1]
            n, holds = np.zeros((2, len(words)), np.int64)
            last, own = -1, None
            for k, _, _, i in hit_arrays(words, batch.column(1).to_pylist(), kind):
                # notes that come once are summed here; a note's hits may come in several parts
                once = ~apart[k]
                n += np.bincount(i[once], minlength=len(words))
                seen = np.unique(k * len(words) + i)
                note, word = seen // len(words), seen % len(words)
                fresh = np.ones(len(seen), bool)
                if last >= 0:
                    fresh[note == last] = ~np.isin(word[note == last], own)
                holds += np.bincount(word[fresh & ~apart[note] & named[1][note]], minlength=len(words))
                own = np.union1d(own, word[note == note[-1]]) if last == note[-1] else word[note == note[-1]]
                last = note[-1]
                if not once.all():
                    pairs, counts = np.unique((k * len(words) + i)[~once], return_counts=True)
                    yield _counts(named[0][pairs // len(words)], pairs % len(words), counts, np.zeros(len(pairs), np.int64))
            some = np.nonzero(n)[0]
            yield _counts(None, some, n[some], holds[some])

    found = rows.mapInArrow(scan, "note_id long, surface_id long, n long, notes long")
    sums = found.filter("note_id IS NULL").groupBy("surface_id").agg(F.sum("n").alias("n"), F.sum("notes").alias("notes"))
    if n_again:
        pairs = found.filter("note_id IS NOT NULL")
        # the pairs of a task stay as few however many there are
        parts = max(int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // 10_000)
        pairs = pairs.repartition(parts, "surface_id", "note_id").groupBy("surface_id", "note_id").agg(F.sum("n").alias("n"))
        pairs = pairs.groupBy("surface_id").agg(F.sum("n").alias("n"), F.count("note_id").alias("notes"))
        sums = sums.unionByName(pairs).groupBy("surface_id").agg(F.sum("n").alias("n"), F.sum("notes").alias("notes"))
    return _named(sums, dictionary)


def _counts(notes: np.ndarray | None, surfaces: np.ndarray, n: np.ndarray, holds: np.ndarray) -> pa.RecordBatch:
    ids = pa.nulls(len(surfaces), pa.int64()) if notes is None else pa.array(notes, pa.int64())
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in (surfaces, n, holds))], ["note_id", "surface_id", "n", "notes"])


def _summed(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    sums = found.groupBy("surface_id", "note_id").agg(F.sum("n").alias("n")).groupBy("surface_id").agg(F.sum("n").alias("n"), F.count("note_id").alias("notes"))
    return _named(sums, dictionary)


def _named(sums: DataFrame, dictionary: DataFrame) -> DataFrame:
    return sums.join(dictionary, "surface_id").select(F.col("pattern").alias("surface"), "n", "notes")


def match_surfaces(notes: DataFrame, lists: DataFrame, report: DataFrame | None, id_col: str, text: str, kind: str = "overlapping", window: int | None = None) -> DataFrame:
    """(note_id, start, end, surface_id, surface, qids) of matches with candidates left.

    `lists` has surface_key and qids; `report` (qid, report) is the policy, applied before the dictionary is built,
    or None for all candidates. With `window`, the text of a longer surface is null.
    """
    kept = filter_candidates(lists, report) if report is not None else lists.filter(F.size("qids") > 0).select("surface_key", "qids")
    kept = stage(dense_ids(kept, "surface_key", "surface_id"), "surfaces")
    words = kept.select("surface_id", F.col("surface_key").alias("pattern"))
    found = match_dictionary(notes, collect_patterns(words), id_col, text, kind) if fits(words) else match_sharded(notes, words, id_col, text, kind)
    # matches are never the side that is sent to all
    found = found.join(beside(kept.select("surface_id", "qids"), kept.count(), 1_000_000), "surface_id")
    if window is not None:
        found = found.withColumn("surface", F.when(F.col("end") - F.col("start") <= window, F.col("surface")))
    return found.select("note_id", "start", "end", "surface_id", "surface", "qids")


def num_states(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """States of the trie: distinct prefixes, and the root."""
    n = F.length(pattern)
    prefixes = patterns.filter(n > 0).select(F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(F.col(pattern), F.lit(1), k))).alias("prefix"))
    return prefixes.agg((F.count_distinct("prefix") + 1).alias("num_states"))
