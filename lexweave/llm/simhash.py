"""SimHash near-dedup by a binary trie self-join.

Fingerprints are made batch-wise in Arrow tasks. Documents with the same fingerprint form one class, and
only distinct fingerprints are joined: the trie of their 64 bits is joined with itself by a walk over pairs of
nodes that starts at the pair of the root with itself. Differing bits accumulate on the way down, and a pair
whose sum exceeds the budget is pruned, as is one with an empty node. While a pair holds more than
`most_leaves` fingerprints, Spark opens it from a table of prefix counts (the root always, by four bits or as
many more as even fingerprints need, later pairs by four), so only node pairs are handled, not their rows. Then each
remaining pair of subtrees meets in a task of its own, which walks on in the same way bit by bit. Every link
is found in exactly one place. Links between distinct fingerprints then form components.

Defined results: a null or empty text (or one without words) has fingerprint zero and links like any other;
a text of one or two words hashes its whole word sequence. Null ids belong to components but never name
one; a component of null ids alone has a null component_id. Repeated rows share a class. An empty table
gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexweave.llm.components import connected_components
from lexweave.llm.hotjoin import join_hot
from lexweave.session import ship
from lexweave.staging import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SEED = 42
BITS, STEP = 64, 4


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text as an unsigned 64-bit number."""
    words = [w.encode() for w in WORD.findall((text or "").translate(LOWER))]
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - last + 1]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[last - 1 :].tolist(), strict=True)), "<u8", len(starts)))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of some unsigned 64-bit hashes have; zero for none."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: str, shingle: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf(LongType())
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return simhash(F.col(text))


def _pairs_within(left: np.ndarray, right: np.ndarray, same: bool, budget: int, few: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted 64-bit arrays with at most `budget` differing bits, by a joint walk of two tries.

    A trie node is a range of the sorted array; a frontier holds node pairs with the bits they differ in so
    far. A pair of nodes with `few` pairs of leaves is not opened further.
    """
    if not len(left) or not len(right):
        return
    stack = [(np.array([[0, len(left), 0, len(right), 0]]), BITS - 1)]
    while stack:
        front, bit = stack.pop()
        pairs = (front[:, 1] - front[:, 0]) * (front[:, 3] - front[:, 2])
        small = (pairs <= few) | (bit < 0)
        if small.any():
            ends, count = front[small], pairs[small]
            which = np.repeat(np.arange(len(ends)), count)
            k, wide = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count), (ends[:, 3] - ends[:, 2])[which]
            i, j = ends[which, 0] + k // wide, ends[which, 2] + k % wide
            near = np.bitwise_count(left[i] ^ right[j]) <= budget
            near &= (i < j) if same else True
            if near.any():
                yield i[near], j[near]
        front = front[~small]
        if not len(front):
            continue
        one = np.uint64(1) << np.uint64(bit)
        cut = []
        for values, lo, hi in ((left, 0, 1), (right, 2, 3)):  # where this bit turns to 1 within the node
            first = values[front[:, lo]] >> np.uint64(bit + 1) << np.uint64(bit + 1) if bit < BITS - 1 else np.zeros(len(front), np.uint64)
            cut.append(np.clip(np.searchsorted(values, first | one), front[:, lo], front[:, hi]))
        p, q = cut
        a0, a1, b0, b1, d = front.T
        children = [np.stack(x, 1) for x in ((a0, p, b0, q, d), (p, a1, q, b1, d), (a0, p, q, b1, d + 1), (p, a1, b0, q, d + 1))]
        nxt = np.concatenate(children)
        nxt = nxt[(nxt[:, 4] <= budget) & (nxt[:, 1] > nxt[:, 0]) & (nxt[:, 3] > nxt[:, 2])]
        if same:  # of two mirrored node pairs one is enough
            nxt = nxt[nxt[:, 0] <= nxt[:, 2]]
        for at in range(0, len(nxt), 65_536):
            stack.append((nxt[at : at + 65_536], bit - 1))


def _masks(bits: int, budget: int) -> Column:
    """Every way to differ in `bits` bits within the budget: (m, the differing bits; c, how many)."""
    found = [sum(1 << k for k in chosen) for n in range(budget + 1) for chosen in combinations(range(bits), n)]
    return F.array(*[F.struct(F.lit(m).cast("bigint").alias("m"), F.lit(m.bit_count()).alias("c")) for m in found])


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("fp", BITS - bits) if bits else F.lit(0).cast("bigint")


def node_pairs(fps: DataFrame, budget: int, most_leaves: int) -> list[tuple[int, DataFrame]]:
    """(depth, pairs) of the walk's last node pairs: a <= b, the nodes' prefixes of `depth` bits."""
    spark, whole = fps.sparkSession, fps.count()
    if not whole:
        return []
    depth, step = 0, max(STEP, min(20, (2 * whole // most_leaves).bit_length()))
    open_ = spark.range(1).select(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("differ"))
    out = []
    while True:
        child = depth + step
        # of the open nodes, how many fingerprints each child holds
        nodes = open_.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        counts = fps.groupBy(_prefix(child).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).withColumn("node", F.shiftrightunsigned("prefix", step) if depth else F.lit(0).cast("bigint"))
        counts = stage(counts.join(nodes, "node", "left_semi"), "trie-counts")
        left = counts.select(F.col("node").alias("a"), F.col("prefix").alias("p"), F.col("n").alias("np"))
        right = counts.select(F.col("prefix").alias("q"), F.col("n").alias("nq"))
        low = F.col("p").bitwiseAND((1 << step) - 1)
        pairs = open_.join(left, "a").withColumn("x", F.explode(_masks(step, budget))).withColumn("q", F.shiftleft("b", step).bitwiseOR(low.bitwiseXOR(F.col("x.m"))))
        pairs = pairs.withColumn("differ", F.col("differ") + F.col("x.c")).filter((F.col("differ") <= budget) & ((F.col("a") != F.col("b")) | (F.col("p") <= F.col("q"))))
        pairs = pairs.join(right, "q").filter((F.col("p") != F.col("q")) | (F.col("np") > 1))
        size = F.col("np") + F.when(F.col("p") == F.col("q"), 0).otherwise(F.col("nq"))
        pairs = stage(pairs.select(F.col("p").alias("a"), F.col("q").alias("b"), "differ", size.alias("size")), "node-pairs")
        depth, step = child, min(STEP, BITS - child)
        done = (F.col("size") <= most_leaves) | F.lit(step == 0)
        out.append((depth, pairs.filter(done).select("a", "b")))
        open_ = pairs.filter(~done).select("a", "b", "differ")
        if open_.isEmpty():
            return out


def links_within(fps: DataFrame, budget: int = 2, most_leaves: int | None = None) -> DataFrame:
    """Links (u, v) between distinct fingerprints `fp` (signed long, no repeats) that differ in at most `budget` bits.

    Nodes of up to `most_leaves` fingerprints (a million unless given) together are walked by one task.
    """
    ship(fps.sparkSession)
    most_leaves = most_leaves or 1_000_000
    met = []
    for depth, pairs in node_pairs(fps, budget, most_leaves):
        one, two = F.struct(F.col("a").alias("prefix"), F.when(F.col("a") == F.col("b"), 0).otherwise(1).alias("side")), F.struct(F.col("b").alias("prefix"), F.lit(2).alias("side"))
        sides = pairs.withColumn("s", F.explode(F.array(one, two))).select("a", "b", "s.*").filter("side < 2 or a <> b")
        met.append(fps.withColumn("prefix", _prefix(depth)).join(sides, "prefix").select(F.lit(depth).alias("depth"), "a", "b", "side", "fp"))
    if not met:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    rows = met[0]
    for more in met[1:]:
        rows = rows.unionByName(more)

    def joined(batch: pd.DataFrame) -> pd.DataFrame:
        values, side = batch["fp"].to_numpy().view(np.uint64), batch["side"].to_numpy()
        a, b = np.sort(values[side != 2]), np.sort(values[side != 1])
        found = list(_pairs_within(a, b, not side.any(), budget))
        u, v = (np.concatenate([f[k] for f in found] or [np.zeros(0, int)]) for k in (0, 1))
        return pd.DataFrame({"u": a[u].view(np.int64), "v": b[v].view(np.int64)})

    return rows.groupBy("depth", "a", "b").applyInPandas(joined, "u long, v long")


def near_classes(prints: DataFrame, budget: int = 2) -> DataFrame:
    """(fp, docs, root, component_id) of each distinct fingerprint in `prints` (doc_id, fp); docs is its number of rows."""
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("docs")), "classes")
    roots = connected_components(links_within(classes.select("fp"), budget))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", "docs", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.select("fp", "docs", "root").join(named, "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) a row of `docs`."""
    ship(docs.sparkSession)
    prints = stage(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(text, shingle).alias("fp")), "fingerprints")
    classes = stage(near_classes(prints, budget), "near-classes")
    found = join_hot(prints, classes, "fp", "docs", prints.count())
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """`docs` without all but one document of each component: the one whose id names it stays.

    Of repeated rows of that id one stays. Rows with a null id stay if no row of their component has an id,
    one for each text.
    """
    return keep_named(docs, near_duplicates(docs, id_col, text, shingle, budget), id_col, text)


def keep_named(docs: DataFrame, found: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rows of `docs` that name their component in `found` (doc_id, component_id), as keep_one() defines."""
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_lw_rows"))
    stays = stage(stays, "stays").withColumnRenamed("doc_id", "_lw_id")
    # the ids that stay grow with the documents: they are never broadcast, whatever their size now
    once, often = stays.filter("_lw_rows = 1"), stays.filter("_lw_rows > 1")
    single = docs.join(once.hint("merge"), docs[id_col].eqNullSafe(once["_lw_id"]))
    if often.isEmpty():
        return single.drop("_lw_id", "_lw_rows")
    # repeated ids are reduced before the join by partial aggregation: a row for each id and, without an id, each text
    own = F.when(F.col(id_col).isNull(), F.xxhash64(text))
    firsts = docs.withColumn("_lw_text", own).dropDuplicates([id_col, "_lw_text"])
    several = firsts.join(often.hint("merge"), firsts[id_col].eqNullSafe(often["_lw_id"]))
    return single.drop("_lw_id", "_lw_rows").unionByName(several.drop("_lw_id", "_lw_rows", "_lw_text"))
