"""Near-dedup of documents by the Jaccard similarity of their word shingles.

Documents with the same set of shingles form one class, and only classes are compared. Candidates come from
the SimHash trie join, over fingerprints of the sets, and, as that cannot reach far enough (the fingerprints of
a pair of similarity 0.8 differ in about ten bits), from MinHash bands: `BANDS` bands of `ROWS` minima each, which
such a pair shares at least once with a probability of 0.998. A candidate only counts once the exact Jaccard
similarity of its two sets has been found high enough.

Within a bucket of a band each class is compared with the least one; what that and the trie join link forms
components. Buckets that still hold several components are compared pair by pair if they have `SMALL` classes at most;
classes of larger ones (many texts from one template, say) are dealt once more, into the finer buckets of `SUBSETS` fixed choices of `CHOSEN` minima, and again each is compared with the
least one of its bucket. So a large group of texts that resemble each other, near copies or not, costs its size
and not its square. A pair of similarity 0.8 shares some finer bucket with a probability of 0.99.

Defined results: case of A-Z and white space do not count; a null or empty text has the empty set, and all of
those are alike; a text of fewer words than a shingle has one shingle, its whole word sequence. Null ids
belong to components but never name one. Repeated rows share a class. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lexweave.llm.components import connected_components
from lexweave.llm.hotjoin import join_hot
from lexweave.llm.simhash import LOWER, SEED, WORD, keep_named, links_within, majority
from lexweave.llm.textmap import slices
from lexweave.session import ship
from lexweave.staging import stage

BANDS, ROWS = 20, 6
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]
_MUL = _RNG.integers(0, 1 << 31, BANDS * ROWS, np.uint32)[:, None] * np.uint32(2) + np.uint32(1)


#: Buckets of so few classes are compared pair by pair.
SMALL = 32
#: Of the minima, those that make up each finer bucket.
SUBSETS, CHOSEN = 256, 14
_SUBSETS = np.stack([np.sort(_RNG.permutation(BANDS * ROWS)[:CHOSEN]) for _ in range(SUBSETS)])


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct shingles of a text as sorted unsigned 64-bit hashes."""
    words = [w.encode() for w in WORD.findall((text or "").translate(LOWER))]
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - last + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[last - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def set_key(found: np.ndarray) -> int:
    """One number for a set of shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def minima(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    folded = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(folded), 4096):
        least = np.minimum(least, ((folded[None, at : at + 4096] ^ _XOR) * _MUL).min(axis=1))
    return least


def _numbered_hashes(rows: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def band_hashes(found: np.ndarray) -> np.ndarray:
    """A hash of each band's minima as signed longs; none for the empty set."""
    return _numbered_hashes(minima(found).reshape(BANDS, ROWS)) if len(found) else np.zeros(0, np.int64)


def finer_hashes(found: np.ndarray) -> np.ndarray:
    """A hash of each choice of minima as signed longs."""
    return _numbered_hashes(minima(found)[_SUBSETS])


def _sketches(shingle: int):
    @F.pandas_udf("key long, n int, fp long, bands array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in chain.from_iterable(map(slices, batches)):
            sets = [shingle_set(t, shingle) for t in texts]
            yield pd.DataFrame({"key": np.array([set_key(s) for s in sets], np.int64), "n": np.array([len(s) for s in sets], np.int32), "fp": np.array([majority(s) for s in sets], np.uint64).view(np.int64), "bands": [band_hashes(s) for s in sets]})

    return sketch


@F.pandas_udf(ArrayType(LongType()))
def _finer(items: pd.Series) -> pd.Series:
    return items.map(lambda found: finer_hashes(np.asarray(found, np.int64).view(np.uint64)))


def _sets(sources: DataFrame, shingle: int) -> DataFrame:
    """(key, items) of those rows of `sources` (key, text) whose text has the set of that key.

    Rows are compared where the sets are made: a filter on the columns of a function moves below them, and the
    function then runs twice, in two Python workers a task.
    """

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for texts in slices(batch["text"]):
                made = [(key, found.view(np.int64)) for key, found in zip(batch["key"][texts.index], (shingle_set(t, shingle) for t in texts), strict=True) if set_key(found) == key]
                if made:
                    yield pd.DataFrame({"key": [key for key, _ in made], "items": pd.Series([found for _, found in made], dtype=object)})

    return sources.select("key", "text").mapInPandas(items, "key long, items array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of `pairs` (u, v) whose sets have a Jaccard similarity of `least` or more."""
    left = sets.select(F.col("key").alias("u"), F.col("items").alias("a")).hint("merge")
    right = sets.select(F.col("key").alias("v"), F.col("items").alias("b")).hint("merge")
    both = pairs.join(left, "u").join(right, "v").withColumn("common", F.size(F.array_intersect("a", "b")))
    return both.filter(F.col("common") >= least * (F.size("a") + F.size("b") - F.col("common"))).select("u", "v")


def _size_fits(n: Column, m: Column, least: float) -> Column:
    return F.least(n, m) >= least * F.greatest(n, m)


def _trie_pairs(classes: DataFrame) -> DataFrame:
    """(u, v), u < v: classes of one fingerprint with the least of them, and the least ones of fingerprints the trie join links."""
    held = stage(classes.filter("n > 0").groupBy("fp").agg(F.min("key").alias("least")), "set-prints")
    same = classes.filter("n > 0").join(held, "fp").filter("key > least").select(F.col("least").alias("u"), F.col("key").alias("v"))
    left, right = (held.select(F.col("fp").alias(f), F.col("least").alias(k)) for f, k in (("u", "a"), ("v", "b")))
    near = links_within(held.select("fp")).join(left, "u").join(right, "v")
    return same.unionByName(near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def near_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) a row of `docs`; a component is linked by pairs of at least `similarity`."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    held = F.xxhash64("text").alias("held")
    rows = texts.select("doc_id", held, _sketches(shingle)("text").alias("s")).select("doc_id", "held", "s.*")
    rows = stage(rows, "sketches")
    # of each class the least id, and one row whose text stands for all
    classes = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "held")).alias("stands"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("docs"))
    classes = stage(classes, "set-classes")
    bands = rows.select("key", "n", F.explode("bands").alias("band")).distinct()
    full = bands.groupBy("band").agg(F.min(F.struct("key", "n")).alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    bands = stage(bands.join(full, "band"), "bands")
    close = stage(_trie_pairs(classes), "trie-pairs")
    wanted = bands.select("key").unionByName(close.select(F.explode(F.array("u", "v")).alias("key"))).distinct().join(classes, "key").select("key", F.col("stands.doc_id").alias("want_id"), F.col("stands.held").alias("want_held"))
    sources = texts.select("doc_id", "text", held).join(wanted.hint("merge"), (F.col("held") == F.col("want_held")) & F.col("doc_id").eqNullSafe(F.col("want_id")))
    # repeated rows of the one that stands for its class are read once
    sources = sources.groupBy("key").agg(F.first("text").alias("text"))
    sets = stage(_sets(sources, shingle), "shingle-sets")
    star = bands.filter((F.col("key") > F.col("least.key")) & _size_fits(F.col("n"), F.col("least.n"), similarity)).select(F.col("least.key").alias("u"), F.col("key").alias("v")).unionByName(close).distinct()
    links = stage(_alike(star, sets, similarity), "links")
    roots = stage(connected_components(links), "roots")
    # classes of buckets in which the comparison with the least one has left several components
    placed = bands.select("band", "key", "n").join(roots, F.col("key") == F.col("node"), "left").select("band", "key", "n", F.coalesce("root", "key").alias("root"))
    split = placed.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("size")).filter("a <> b and size > 2").select("band", "size")
    split = stage(placed.join(split, "band"), "split-buckets")
    if not split.isEmpty():
        apart = split.filter(F.col("size") > SMALL).select("key", "n", "root").distinct()
        small = split.filter(F.col("size") <= SMALL)
        other = small.select("band", F.col("key").alias("v"), F.col("n").alias("m"), F.col("root").alias("other"))
        few = small.join(other, "band").filter((F.col("root") != F.col("other")) & (F.col("key") < F.col("v")) & _size_fits(F.col("n"), F.col("m"), similarity)).select(F.col("key").alias("u"), "v")
        finer = stage(apart.join(sets, "key").select("key", "n", "root", F.explode(_finer("items")).alias("finer")), "finer-buckets")
        least = finer.groupBy("finer").agg(F.min(F.struct("key", "n", "root")).alias("least"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b")
        rest = finer.join(least.select("finer", "least"), "finer").filter((F.col("root") != F.col("least.root")) & _size_fits(F.col("n"), F.col("least.n"), similarity))
        rest = rest.select(F.col("least.key").alias("u"), F.col("key").alias("v")).unionByName(few).distinct()
        more = stage(_alike(rest, sets, similarity), "links")
        if not more.isEmpty():
            roots = connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
    rooted = classes.join(roots, classes["key"] == roots["node"], "left").select("key", "first", "docs", F.coalesce("root", "key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = stage(rooted.join(named, "root").select("key", "docs", "component_id"), "near-classes")
    return join_hot(rows.select("doc_id", "key"), found, "key", "docs", rows.count()).select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` without all but one document of each component: the one whose id names it stays.

    Of repeated rows of that id one stays. Rows with a null id stay if no row of their component has an id,
    one for each text.
    """
    return keep_named(docs, near_components(docs, id_col, text, shingle, similarity), id_col, text)
