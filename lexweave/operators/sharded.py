"""Dictionary matching for dictionaries of any size: patterns are sharded by a rare gram and joined to texts.

A pattern of GRAM code points at most is its own gram; a longer one is known by that gram of its own which is
rarest in the texts. Rareness comes from counts of all grams of all texts in BUCKETS hash buckets. The driver sees
the counts and a bitmap of the patterns' grams only, whose sizes are fixed.

Texts are dealt into groups of some GROUP_CODES code points. Each group tells which grams of the bitmap it holds, a
join by gram gives it the patterns that may occur there, and an automaton of these alone scans its texts, so that
neither places nor matches are shuffled.

Groups whose patterns have more than GROUP_PATTERNS characters are matched place by place: every place that passes the
bitmap is sent on with its surroundings, a join by gram proposes patterns, and comparing them with the surroundings
decides; patterns that reach beyond are compared with the text itself in a second join. Grams that hold more than
one in HOT_SHARE of these places are dealt over several shards. Match kinds are then folds over the sorted hits of a
text, which hold one hit at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, islice
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import beside, ship
from lexweave.staging import stage

GRAM, AROUND = 8, 32
BUCKETS, BITMAP_BITS, HOT_SHARE = 1 << 16, 1 << 24, 1000
CODES_AT_ONCE, ROWS_AT_ONCE = 1 << 16, 50_000
GROUP_CODES, GROUP_PATTERNS = 1 << 22, 1 << 20
HIT = ["note_id", "start", "end", "surface_id", "surface"]
PLACE = ["note_id", "digest", "gram", "at", "left", "around"]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


FACTOR = 0x9E3779B97F4A7C15


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all windows of `size` code points; of texts shorter than that there are none."""
    (out,) = (hashes for _, hashes in sized_hashes(codes, [size]))
    return out


def sized_hashes(codes: np.ndarray, sizes: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hashes of all windows of that size) for each of `sizes`, the smaller ones first; a window grows code by code."""
    wanted, n, codes = set(sizes), len(codes), codes + np.uint64(1)
    sums = np.zeros(n, np.uint64)
    for size in range(1, max(wanted, default=0) + 1):
        left = max(0, n - size + 1)
        sums = sums[:left] * np.uint64(FACTOR) + codes[size - 1 : size - 1 + left]
        if size in wanted:
            out = sums + np.uint64(size * FACTOR**size % 2**64)
            out ^= out >> np.uint64(32)
            out *= np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(29)
            yield size, out


def _windows(text: str, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, hashes) of stretches of bounded length."""
    codes = _codes(text)
    for at in range(0, max(1, len(codes) - size + 1), CODES_AT_ONCE):
        yield at, gram_hashes(codes[at : at + CODES_AT_ONCE + size - 1], size)


def _stretches(texts: Iterable[str | None], size: int) -> Iterator[np.ndarray]:
    """Codes of the texts end to end, some CODES_AT_ONCE at a time: they hold every window of `size`, and some across two texts."""
    held, n = [], 0
    for text in texts:
        for at in range(0, len(text or ""), CODES_AT_ONCE):
            held.append(text[at : at + CODES_AT_ONCE + size - 1])
            n += len(held[-1])
            if n >= CODES_AT_ONCE:
                yield _codes("".join(held))
                held, n = [], 0
    if held:
        yield _codes("".join(held))


def _gram_counts(notes: DataFrame) -> np.ndarray:
    """How often grams of GRAM code points occur in the texts, by hash bucket; those across two texts count as well."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(BUCKETS, np.int64)
        for codes in _stretches((text for batch in batches for text in batch["text"]), GRAM):
            found += np.bincount((gram_hashes(codes, GRAM) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        full = np.nonzero(found)[0]
        yield pd.DataFrame({"bucket": full, "n": found[full]})

    sums = notes.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in sums.collect():  # BUCKETS rows at most
        out[row["bucket"]] = row["n"]
    return out


def _anchored(dictionary: DataFrame, counts: np.ndarray) -> DataFrame:
    """Patterns with their gram: hash, size and place within the pattern."""
    shared = dictionary.sparkSession.sparkContext.broadcast(counts)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pattern in batch["pattern"]:
                size = min(len(pattern), GRAM)
                hashes = gram_hashes(_codes(pattern), size)
                at = int(shared.value[(hashes % np.uint64(BUCKETS)).astype(np.int64)].argmin()) if len(hashes) > 1 else 0
                rows.append((int(hashes[at].astype(np.int64)), size, at))
            yield batch.assign(**dict(zip(("gram", "size", "offset"), np.array(rows, np.int64).reshape(-1, 3).T, strict=True)))

    return dictionary.mapInPandas(choose, "surface_id long, pattern string, gram long, size int, offset int")


def _bitmap(anchors: DataFrame) -> np.ndarray:
    """A bit for each hash of a gram; BITMAP_BITS bits, fetched in pieces of 4 KB."""
    bit = F.pmod("gram", F.lit(BITMAP_BITS)) + 1  # these functions count from 1
    pieces = anchors.groupBy(F.bitmap_bucket_number(bit).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in pieces:
        bits = np.frombuffer(row["bits"], np.uint8)
        first = (row["piece"] - 1) * len(bits)
        out[first : first + len(bits)] = bits
    return out


def _reach(anchors: DataFrame) -> dict[int, tuple[int, int]]:
    """By size of gram, how far patterns reach before and behind it, AROUND at most; GRAM sizes at most."""
    rest = F.length("pattern") - F.col("offset") - F.col("size")
    found = anchors.groupBy("size").agg(F.max("offset").alias("ahead"), F.max(rest).alias("behind")).collect()
    return {r["size"]: (min(r["ahead"], AROUND), min(r["behind"], AROUND)) for r in sorted(found, key=lambda r: r["size"])}


def _places(notes: DataFrame, bitmap: np.ndarray, reach: dict[int, tuple[int, int]]) -> DataFrame:
    """(note_id, digest, gram, at, left, around): every place whose gram may be a pattern's, with what patterns may reach around it."""
    shared = notes.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, frames, n = shared.value, [], 0
        for batch in batches:
            for note, digest, text in zip(batch["note_id"], batch["digest"], batch["text"], strict=True):
                for size, (ahead, behind) in reach.items():
                    for base, hashes in _windows(text or "", size):
                        bit = (hashes % np.uint64(BITMAP_BITS)).astype(np.int64)
                        found = np.nonzero(bits[bit >> 3] >> (bit & 7) & 1)[0]
                        for some in np.split(found, range(ROWS_AT_ONCE, len(found), ROWS_AT_ONCE)) if len(found) else []:
                            at = some + base
                            left = np.minimum(at, ahead)
                            around = [text[a : b + size + behind] for a, b in zip((at - left).tolist(), at.tolist(), strict=True)]
                            frames.append((np.full(len(at), note), np.full(len(at), digest), hashes[some].astype(np.int64), at, left, np.array(around, object)))
                            n += len(at)
                            if n >= ROWS_AT_ONCE:
                                yield joined(frames)
                                frames, n = [], 0
        if frames:
            yield joined(frames)

    def joined(frames: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: np.concatenate(parts) for c, parts in zip(PLACE, zip(*frames, strict=True), strict=True)})

    return notes.withColumn("digest", F.xxhash64("text")).mapInPandas(scan, "note_id long, digest long, gram long, at int, left int, around string")


def _by_gram(places: DataFrame, anchors: DataFrame) -> DataFrame:
    """`places` joined with the patterns of their gram; frequent grams are dealt over shards."""
    total = places.count()
    share = max(1, total // HOT_SHARE)
    hot = stage(places.groupBy("gram").count().filter(F.col("count") > share).select("gram", F.ceil(F.col("count") / share).cast("int").alias("shards")), "hot-grams")
    # fewer than HOT_SHARE rows, whatever the input
    dealt = places.join(F.broadcast(hot), "gram", "left").withColumn("shard", F.when(F.col("shards").isNull(), 0).otherwise(F.pmod(F.xxhash64("note_id", "at"), F.col("shards")))).drop("shards")
    copied = anchors.join(F.broadcast(hot), "gram", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1))).drop("shards")
    return dealt.join(copied.withColumn("shard", F.col("shard").cast("bigint")), ["gram", "shard"])


class Patterns(NamedTuple):
    """A dictionary (surface_id, pattern, gram, size, offset), the bitmap of its grams and how far it reaches around them."""

    anchors: DataFrame
    bitmap: np.ndarray
    reach: dict[int, tuple[int, int]]
    n: int
    codes: int  # of all texts, more or less


def _patterns(notes: DataFrame, dictionary: DataFrame) -> Patterns:
    patterns = stage(dictionary.select(F.col("surface_id").cast("bigint").alias("surface_id"), "pattern"), "patterns")
    facts = patterns.agg(F.min(F.length("pattern")), F.max(F.length("pattern")), F.count(F.lit(1))).first()
    if facts[0] == 0:
        raise ValueError("an empty pattern can't be sharded")
    if (facts[1] or 0) > GRAM:
        counts = _gram_counts(notes)
        codes = int(counts.sum())
    else:
        counts = np.zeros(BUCKETS, np.int64)
        codes = notes.agg(F.sum(F.length("text"))).first()[0] or 0
    anchors = stage(_anchored(patterns, counts), "anchors")
    return Patterns(anchors, _bitmap(anchors), _reach(anchors), facts[2], codes)


def _group_grams(texts: DataFrame, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """(part, gram): grams of the bitmap that the texts of (part, text) hold, a partition a part; the same gram may come again."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, ones, widest = shared.value, 1 << np.arange(8, dtype=np.uint8), max(sizes)
        found, n, part = [], 0, None
        for batch in batches:
            part = batch.column(0)[:1]
            for codes in _stretches(batch.column(1).to_pylist(), widest):
                for _, hashes in sized_hashes(codes, sizes):
                    bit = (hashes & np.uint64(BITMAP_BITS - 1)).view(np.int64)
                    found.append(np.unique(hashes[bits.take(bit >> 3) & ones.take(bit & 7) != 0]))
                    n += len(found[-1])
                if n > 20 * ROWS_AT_ONCE:
                    found = [np.unique(np.concatenate(found))]
                    n = len(found[0])
                    if n > 10 * ROWS_AT_ONCE:
                        yield told(part, found)
                        found, n = [], 0
        if n:
            yield told(part, found)

    def told(part: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
        grams = np.unique(np.concatenate(found)).view(np.int64)
        return pa.RecordBatch.from_arrays([part.take(pa.array(np.zeros(len(grams), np.int64))), pa.array(grams)], ["part", "gram"])

    return texts.select("part", "text").mapInArrow(scan, "part int, gram long")


class Scan:
    """Matches of one kind in many texts at once, by patterns in order of their ids, none of them empty."""

    def __init__(self, patterns: tuple[str, ...], kind: str) -> None:
        numbers: dict[str, list[int]] = {}
        for i, p in enumerate(patterns):
            numbers.setdefault(p, []).append(i)
        self.patterns, self.kind, self.found = patterns, kind, ahocorasick.Automaton()
        for k, p in enumerate(numbers):
            self.found.add_word(p, k)
        if numbers:
            self.found.make_automaton()
        self.sizes = np.array([len(p) for p in numbers], np.int64)
        self.first = np.array([ids[0] for ids in numbers.values()], np.int64)
        self.times = np.array([len(ids) for ids in numbers.values()], np.int64)
        self.numbers = np.array([i for ids in numbers.values() for i in ids], np.int64)

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
        """(number of the text, start, end, pattern) of the matches as arrays; texts with very many hits go hit by hit."""
        from lexweave.operators.matching import hit_arrays  # which imports this module

        parts, n = [], 0
        for k, text in enumerate(texts if len(self.found) else []):
            room = ROWS_AT_ONCE * 10
            flat = np.fromiter(islice(chain.from_iterable(self.found.iter(text or "")), 2 * room), np.int64)
            if len(flat) == 2 * room:
                for _, *hits in hit_arrays(self.patterns, [text], self.kind):
                    yield np.full(len(hits[0]), k), *hits
                continue
            parts.append((k, len(text or ""), flat))
            n += len(flat) // 2
            if n >= ROWS_AT_ONCE:
                yield self.chosen(parts)
                parts, n = [], 0
        if n:
            yield self.chosen(parts)

    def chosen(self, parts: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, ...]:
        """The matches among all hits (end - 1, pattern) of some texts, which are laid end to end for it."""
        k, lengths, flat = zip(*parts, strict=True)
        row = np.repeat(np.arange(len(k)), [len(f) // 2 for f in flat])
        base = np.cumsum([0, *lengths[:-1]])
        end, p = np.concatenate(flat).reshape(-1, 2).T
        end = end + 1 + base[row]
        start = end - self.sizes[p]
        wide = self.sizes.max() + 1
        if self.kind == "overlapping":
            took = np.repeat(np.arange(len(p)), self.times[p])
            again = np.arange(len(took)) - np.repeat(np.cumsum(self.times[p]) - self.times[p], self.times[p])
            ids = self.numbers[(np.cumsum(self.times) - self.times)[p[took]] + again]
        elif self.kind in ("longest_per_end", "nonoverlap"):
            took = np.argsort(end * wide - self.sizes[p])
            if self.kind == "nonoverlap":
                took = took[_by_ends(start[took].tolist(), end[took].tolist())]
            else:
                took = took[np.diff(end[took], prepend=-1) != 0]
            ids = self.first[p[took]]
        else:
            took = np.argsort(start * wide - self.sizes[p] if self.kind == "leftmost_longest" else start * len(self.patterns) + self.first[p])
            took = took[np.diff(start[took], prepend=-1) != 0]
            took = took[_by_starts(start[took], end[took])]
            ids = self.first[p[took]]
        row = row[took]
        return np.array(k)[row], start[took] - base[row], end[took] - base[row], ids


def _by_starts(start: np.ndarray, end: np.ndarray) -> list[int]:
    """Of hits with rising starts the first, then the first that begins at its end or later, and so on."""
    after, k, taken = np.searchsorted(start, end).tolist(), 0, []
    while k < len(after):
        taken.append(k)
        k = after[k]
    return taken


def _by_ends(start: list[int], end: list[int]) -> list[int]:
    """The same of hits in order of their ends."""
    at, taken = 0, []
    for k, a in enumerate(start):
        if a >= at:
            at = end[k]
            taken.append(k)
    return taken


def _scan_groups(rows: DataFrame, kind: str) -> DataFrame:
    """Matches of `kind` in the texts of (of_note, surface_id, note_id, text), where each partition lists its patterns first, by id."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, ready = [], [], None
        for batch in batches:
            known = len(batch) - batch.column(0).true_count
            ids += batch.column(1)[:known].to_pylist()
            words += batch.column(3)[:known].to_pylist()
            if known == len(batch):
                continue
            if ready is None:
                ready = Scan(tuple(words), kind), pa.array(ids, pa.int32()), pa.array(words, pa.string())
            notes, texts = batch.column(2)[known:], batch.column(3)[known:].to_pylist()
            for k, start, end, i in ready[0](texts):
                i = pa.array(i)
                found = [notes.take(pa.array(k)), *(pa.array(c).cast(pa.int32()) for c in (start, end)), ready[1].take(i), ready[2].take(i)]
                yield pa.RecordBatch.from_arrays(found, HIT)

    return rows.select("of_note", "surface_id", "note_id", "text").mapInArrow(scan, "note_id long, start int, end int, surface_id int, surface string")


def _matches(notes: DataFrame, found: Patterns, kind: str) -> tuple[DataFrame, DataFrame | None]:
    """Matches of `kind` in the groups that hold their patterns, and all hits of the other groups, if there are any."""
    spark = notes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found.codes // GROUP_CODES))
    part = F.pmod(F.xxhash64("note_id", "text"), F.lit(parts)).cast("int")
    texts = notes.filter(F.col("text").isNotNull()).withColumn("part", part)
    sizes = list(found.reach) or [GRAM]  # without patterns no gram passes
    grams = stage(_group_grams(texts.repartitionById(parts, "part"), found.bitmap, sizes).distinct(), "group-grams")
    weights = found.anchors.groupBy("gram").agg(F.sum(F.length("pattern")).alias("n"))
    full = stage(grams.join(beside(weights, found.n), "gram").groupBy("part").agg(F.sum("n").alias("n")).filter(F.col("n") > GROUP_PATTERNS).select("part"), "full-groups")
    rest = None
    if not full.isEmpty():
        full = beside(full, parts)
        rest = _hits_by_places(texts.join(full, "part", "left_semi").select("note_id", "text"), found)
        texts, grams = (rows.join(full, "part", "left_anti") for rows in (texts, grams))
    own = grams.join(beside(found.anchors, found.n), "gram").select("part", F.lit(False).alias("of_note"), "surface_id", F.lit(None).cast("bigint").alias("note_id"), F.col("pattern").alias("text"))
    rows = own.unionByName(texts.select("part", F.lit(True).alias("of_note"), F.lit(None).cast("bigint").alias("surface_id"), "note_id", "text"))
    return _scan_groups(rows.repartitionById(parts, "part").sortWithinPartitions("of_note", "surface_id"), kind), rest


def _hits_by_places(notes: DataFrame, found: Patterns) -> DataFrame:
    """All hits of the patterns in (note_id, text), by a join of places."""
    anchors = found.anchors
    places = stage(_places(notes, found.bitmap, found.reach), "gram-places")

    n = F.length("pattern")
    near = _by_gram(places, anchors).withColumn("start", F.col("at") - F.col("offset")).filter("start >= 0")
    skipped = F.greatest(F.col("offset") - F.col("left"), F.lit(0))  # what of the pattern lies before the surroundings
    seen = F.substr("around", F.greatest(F.col("left") - F.col("offset"), F.lit(0)) + 1, n - skipped)
    near = near.filter(F.substr("pattern", skipped + 1, F.length(seen)) == seen).withColumn("whole", F.length(seen) == n)
    hits = near.select("note_id", "digest", "start", (F.col("start") + n).alias("end"), "surface_id", F.col("pattern").alias("surface"), "whole")
    hits = stage(hits, "near-hits")
    far = hits.filter(~F.col("whole")).alias("h")
    texts = notes.select(F.col("note_id").alias("own"), F.xxhash64("text").alias("own_digest"), "text")
    far = far.join(texts, F.col("h.note_id").eqNullSafe(F.col("own")) & (F.col("h.digest") == F.col("own_digest")) & (F.substr("text", F.col("h.start") + 1, F.length("h.surface")) == F.col("h.surface")), "left_semi")
    both = hits.filter("whole").unionByName(far)
    return both.select("note_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("surface_id").cast("int").alias("surface_id"), "surface")


ORDERS: dict[str, list[Column | str]] = {"nonoverlap": ["end", "start", "surface_id"], "leftmost_longest": ["start", "-end", "surface_id"], "leftmost_first": ["start", "surface_id"]}


def _greedy(hits: DataFrame, kind: str) -> DataFrame:
    """Of each note's hits in the order of `kind` the first, then the first that begins at its end or later, and so on."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        note, end = object(), 0  # no id yet; null is one
        for batch in batches:
            taken = []
            for k, (n, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if n != note or a >= end:
                    note, end = n, b
                    taken.append(k)
            yield batch.take(pa.array(taken, pa.int64()))

    order = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c) for c in ORDERS[kind]]
    return hits.select(*HIT).repartition("note_id").sortWithinPartitions("note_id", *order).mapInArrow(fold, "note_id long, start int, end int, surface_id int, surface string")


def match_sharded(notes: DataFrame, dictionary: DataFrame, id_col: str, text: str, kind: str = "overlapping") -> DataFrame:
    """(note_id, start, end, surface_id, surface) of the matches of (surface_id, pattern), a dictionary of any size.

    Kinds other than overlapping take the rows of one note_id as one text.
    """
    if kind not in ("overlapping", "longest_per_end", *ORDERS):
        raise ValueError(f"match kind must be one of overlapping, longest_per_end, {', '.join(ORDERS)}")
    ship(notes.sparkSession)
    texts = notes.select(F.col(id_col).cast("bigint").alias("note_id"), F.col(text).alias("text"))
    found = _patterns(texts, dictionary)
    if kind == "overlapping":
        done, rest = _matches(texts, found, kind)
        return done if rest is None else done.unionByName(rest)
    again = stage(texts.groupBy("note_id").count().filter("count > 1").select(F.col("note_id").alias("own")), "repeated-ids")
    n_again = again.count()
    parted = [texts]
    if n_again:
        parted = [texts.join(beside(again, n_again), F.col("note_id").eqNullSafe(F.col("own")), how) for how in ("left_anti", "left_semi")]
    done, *hits = _matches(parted[0], found, kind)
    if n_again:
        hits += _matches(parted[1], found, "overlapping")
    hits = [h for h in hits if h is not None]
    return done.unionByName(_folded(reduce(DataFrame.unionByName, hits), kind)) if hits else done


def _folded(hits: DataFrame, kind: str) -> DataFrame:
    """Matches of `kind` among all hits."""
    if kind == "longest_per_end":
        longest = Window.partitionBy("note_id", "end").orderBy("start", "surface_id")
        return hits.withColumn("_lw_r", F.row_number().over(longest)).filter("_lw_r = 1").select(*HIT)
    return _greedy(hits, kind)
