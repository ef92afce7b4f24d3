"""Mixing sources to target weights with packed blocks and index permutations.

The words of each source form one stream (documents in hash order), packed into blocks of a fixed number of
words. Targets fix how many slots each source fills; a source's slots are dealt to the output shards by
multinomial draws that keep its total: shards are halved again and again, and a binomial draw keyed by the
source and the half says how many slots go left, so any stretch of shards knows its counts and first slots by
itself. Slot j of a source goes to epoch j div blocks, and a pseudorandom permutation of that epoch (a keyed
Feistel network, walked until it lands in range) names its block. Slots and blocks then join by (source, block).
A source's last slot is cut to the word, so its words meet the target to the nearest word, and nothing is taken
more than once an epoch.

Stream positions come from sums per (source, bucket of the id's hash) with a number of buckets that follows
the source's rows, so a hot source is never ordered in one task. Repeated rows (same id and text) enter the
stream as one entry with a multiplicity, so they are reduced before any shuffle. The plan (one row a source) is
a staged table; the driver sees its totals only.

Defined results: a null text has size 0, takes nothing and keeps its row; a null source is a source of its
own, last in order. Repeated rows each hold a stretch of the stream. Reruns agree whatever the partitioning.
An empty table gives an empty table. Other columns pass through; clashing ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexweave.operators.surfaces import dense_ids
from lexweave.session import ship
from lexweave.staging import stage

WORD_GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def water_level(sources: DataFrame, total: float, most: float) -> float:
    """The words a unit of weight gets, so that targets of least(weight * level, most * size) add up to `total`.

    The excess of sources that are full is reshared by weight until none is above; each round is one aggregate
    over `sources` (size, weight), and there are as few of them as the level has steps.
    """
    full = F.col("size") * most
    level = -1.0
    while True:
        over = F.col("weight") * level > full
        got = sources.filter("size > 0").agg(F.sum(F.when(over, full)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if not got["open"]:
            return max(level, 0.0)
        new = (total - (got["full"] or 0.0)) / got["open"]
        if new <= level:
            return level
        level = new


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(size) for each key, applied elementwise."""
    size = size.astype(np.uint64)
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(float) + 1)) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    key = key.astype(np.uint64)

    def mix(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        x = (x + k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def rounds(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        b, m, k = bits[at], mask[at], key[at]
        left, right = x >> b, x & m
        for r in (3, 2, 1, 0) if inverse else (0, 1, 2, 3):
            salt = mix(k, np.full(len(k), r + 1, np.uint64))
            if inverse:
                left, right = right ^ (mix(left, salt) & m), left
            else:
                left, right = right, left ^ (mix(right, salt) & m)
        return (left << b) | right

    out, open_ = index.astype(np.uint64), np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(open_):  # a value outside range(size) walks on until it comes back in
            out[open_] = rounds(out[open_], open_)
            open_ = open_[out[open_] >= size[open_]]
    return out.astype(np.int64)


PLAN = "_lw_s long, source string, source_size long, rows long, target double, blocks long, slots long, words long, key long"


def plan_sources(docs_by_source: DataFrame, block: int, weights: tuple[float, ...], share: float, most: float, seed: int) -> DataFrame:
    """PLAN of each source of (source, size, rows): its number in code point order, null last, its target and its slots."""
    spark = docs_by_source.sparkSession
    named = dense_ids(docs_by_source.filter(F.col("source").isNotNull()), "source", "_lw_s")
    last = named.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    numbered = named.unionByName(docs_by_source.filter(F.col("source").isNull()).withColumn("_lw_s", F.lit(last).cast("bigint")))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_lw_s") % len(weights)).cast("int"))
    numbered = stage(numbered.withColumn("weight", weight), "sources")
    total = share * (numbered.agg(F.sum("size").alias("n")).first()["n"] or 0)
    level = water_level(numbered, total, most)
    target = F.when(F.col("size") > 0, F.least(F.col("weight") * level, F.col("size") * most)).otherwise(0.0)

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["size"].to_numpy()
            words = np.minimum(np.round(batch["target"]), np.floor(most * size)).astype(np.int64)
            blocks, key = -(-size // block), (seed << 32) + batch["_lw_s"].to_numpy() * 1_000_003
            epochs, left = np.divmod(words, np.maximum(size, 1))
            epochs = np.where(size > 0, epochs, 0)
            short_at = permute(np.maximum(blocks - 1, 0), np.maximum(blocks, 1), key + epochs, inverse=True)
            n = -(-left // block)
            n = np.where(n <= short_at, n, -(-(left + blocks * block - size) // block))  # the short last block came before the end
            count = np.where(size > 0, epochs * blocks + np.where(left > 0, np.maximum(n, 1), 0), 0)
            yield pd.DataFrame({"_lw_s": batch["_lw_s"], "source": batch["source"], "source_size": size, "rows": batch["rows"], "target": batch["target"], "blocks": blocks, "slots": count, "words": words, "key": key})

    planned = numbered.withColumn("target", target).select("_lw_s", "source", "size", "rows", "target").mapInPandas(slots, PLAN)
    return stage(planned, "source-plan")


def left_share(n: int, low: int, middle: int, high: int, key: int) -> int:
    """Of `n` slots for the shards low to high, how many go to those below `middle`: a binomial draw keyed by its arguments."""
    return int(np.random.default_rng([key, low, high]).binomial(n, (middle - low) / (high - low))) if n else 0


def dealt(n: int, shards: int, low: int, high: int, key: int) -> Iterator[tuple[int, int, int]]:
    """(shard, slots, first slot) of the shards from `low` to below `high` that get some of `n` slots."""
    todo = [(0, shards, n, 0)]
    while todo:
        a, b, count, first = todo.pop()
        if not count or b <= low or a >= high:
            continue
        if b - a == 1:
            yield a, count, first
            continue
        middle = (a + b) // 2
        left = left_share(count, a, middle, b, key)
        todo += [(middle, b, count - left, first + left), (a, middle, left, first)]


CARRIED = ("_lw_s", "blocks", "source_size", "slots", "words", "key")
COPIES_AT_ONCE = 10_000


def _each_copy(placed: DataFrame) -> DataFrame:
    """A row for each copy, its offset behind those of the copies before it."""
    one = placed.filter("copies = 1").drop("copies")
    several = placed.filter("copies > 1").withColumn("_lw_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES_AT_ONCE).cast("bigint"))))
    # a row with very many copies is spread before they are made
    several = several.repartition("_lw_doc", "_lw_c").withColumn("_lw_c", F.explode(F.sequence(F.col("_lw_c"), F.least(F.col("copies"), F.col("_lw_c") + COPIES_AT_ONCE) - 1)))
    return one.unionByName(several.withColumn("offset", F.col("offset") + F.col("size") * F.col("_lw_c")).drop("_lw_c", "copies"))


def _namer(block: int):
    """Epoch, block and words of each slot."""

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            j, blocks, size, key = (batch[c].to_numpy() for c in ("j", "blocks", "source_size", "key"))
            epoch = j // blocks
            at = permute(j % blocks, blocks, key + epoch)
            full = np.minimum(block, size - at * block)
            # the last slot takes what is left of the target
            last, left = j == batch["slots"].to_numpy() - 1, batch["words"].to_numpy() - epoch * size
            short_at = permute(blocks[last] - 1, blocks[last], (key + epoch)[last], inverse=True)
            n = (j % blocks)[last]
            taken = n * block - np.where(short_at < n, blocks[last] * block - size[last], 0)
            full[last] = np.minimum(full[last], left[last] - taken)
            yield pd.DataFrame({"shard": batch["shard"], "_lw_s": batch["_lw_s"], "j": j, "epoch": epoch.astype("int32"), "block": at, "words": full.astype("int32")})

    return named


class Mix:
    """A mix of `docs`: `sized` documents with stream offsets, `pieces` in blocks, and `slots` to fill."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", block: int = 256, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0, slots_per_shard: int = 1 << 16, rows_per_bucket: int = 2_000, shards_per_task: int = 1_024, seed: int = 5) -> None:
        ship(docs.sparkSession)
        base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text).alias("_lw_doc"), F.col(source).alias("source"), F.size(words_of(F.col(text))).cast("bigint").alias("size"))
        base = stage(base.groupBy("doc_id", "_lw_doc", "source", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes")
        by_source = base.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count(F.lit(1)).alias("rows"))
        self.plan = plan_sources(stage(by_source, "source-sizes"), block, weights, share, most, seed)
        self.block, self.text, self.id_col, self.docs = block, text, id_col, docs
        known = self.plan.select(F.col("source").alias("_lw_source"), "_lw_s", "source_size", "target", F.ceil(F.col("rows") / rows_per_bucket).cast("int").alias("buckets"))
        placed = base.join(known, base["source"].eqNullSafe(known["_lw_source"])).drop("_lw_source")
        placed = placed.withColumn("_lw_b", F.pmod(F.xxhash64("_lw_doc", F.lit(seed)), F.col("buckets")).cast("int")).drop("buckets")
        held = F.col("size") * F.col("copies")
        sums = placed.groupBy("_lw_s", "_lw_b").agg(F.sum(held).alias("n"))
        starts = sums.select("_lw_s", "_lw_b", F.coalesce(F.sum("n").over(W.partitionBy("_lw_s").orderBy("_lw_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
        inside = W.partitionBy("_lw_s", "_lw_b").orderBy(F.xxhash64("_lw_doc", F.lit(seed + 1)), "_lw_doc", "doc_id").rowsBetween(W.unboundedPreceding, -1)
        placed = placed.withColumn("before", F.coalesce(F.sum(held).over(inside), F.lit(0)))
        placed = placed.join(starts, ["_lw_s", "_lw_b"]).withColumn("offset", F.col("start") + F.col("before")).drop("start", "before", "_lw_b")
        self.sized = stage(_each_copy(placed), "stream")

        total = self.plan.agg(F.sum("slots").alias("n")).first()["n"] or 0
        shards = max(1, -(-total // slots_per_shard))
        stretches = self.plan.filter("slots > 0").withColumn("low", F.explode(F.sequence(F.lit(0), F.lit(shards - 1), F.lit(shards_per_task))))
        if shards > shards_per_task:  # a hot source is dealt by many tasks
            stretches = stretches.repartition("_lw_s", "low")

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    counts = pd.DataFrame(list(dealt(row["slots"], shards, row["low"], min(shards, row["low"] + shards_per_task), row["key"])), columns=["shard", "n", "first"])
                    yield counts.assign(**{c: row[c] for c in CARRIED})

        parts = stretches.select("low", *CARRIED).mapInPandas(deal, f"shard long, n long, first long, {', '.join(f'{c} long' for c in CARRIED)}")
        slots = parts.withColumn("j", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))).drop("first", "n")
        self.slots = slots.repartition(max(1, total // 500_000), "_lw_s", "j").mapInPandas(_namer(block), "shard long, _lw_s long, j long, epoch int, block long, words int")

    def pieces(self) -> DataFrame:
        """One row a document and block it reaches into: where in the document, where in the block."""
        b = F.lit(self.block)
        spread = self.sized.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / b), F.floor((F.col("offset") + F.col("size") - 1) / b))))
        lo = F.greatest(F.col("offset"), F.col("block") * b)
        hi = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * b)
        return spread.select("_lw_s", "block", "_lw_doc", "offset", (lo - F.col("offset")).alias("doc_from"), (lo - F.col("block") * b).alias("block_from"), (hi - lo).alias("n"))

    def draws(self) -> DataFrame:
        """Slots joined with the pieces of their blocks, cut to the words the slot takes."""
        joined = self.slots.join(self.pieces(), ["_lw_s", "block"])
        return joined.withColumn("n", F.least("n", F.col("words") - F.col("block_from"))).filter("n > 0")

    def taken(self) -> DataFrame:
        """Per document: doc_id, size, source_size, target, taken."""
        sums = self.draws().groupBy("_lw_s", "offset", "_lw_doc").agg(F.sum("n").alias("taken"))
        out = self.sized.join(sums, ["_lw_s", "offset", "_lw_doc"], "left")
        return out.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("bigint").alias("taken"))

    def documents(self) -> DataFrame:
        """The mix as documents: one row a document and epoch that takes from it, its text cut to what is taken.

        A text taken whole is unchanged; of others the taken words are joined by single spaces, in order.
        """
        stretch = F.sort_array(F.collect_list(F.struct("doc_from", "n")))
        parts = self.draws().groupBy("_lw_doc", "offset", "epoch").agg(stretch.alias("_lw_parts"), F.sum("n").alias("_lw_n"))
        parts = parts.hint("merge")  # they grow with the documents and are never broadcast
        whole = self.docs.withColumn("_lw_doc", F.xxhash64(self.id_col, self.text))
        parts = parts.select("_lw_doc", "_lw_parts", "_lw_n")
        once = whole.join(parts, "_lw_doc") if self._no_repeats() else whole.dropDuplicates(["_lw_doc"]).join(parts, "_lw_doc")
        words = F.array_join(F.flatten(F.transform("_lw_parts", lambda p: F.slice("_lw_w", (p["doc_from"] + 1).cast("int"), p["n"].cast("int")))), " ")
        once = once.withColumn("_lw_w", words_of(F.col(self.text)))
        return once.withColumn(self.text, F.when(F.col("_lw_n") == F.size("_lw_w"), F.col(self.text)).otherwise(words)).drop("_lw_w", "_lw_parts", "_lw_n", "_lw_doc")

    def _no_repeats(self) -> bool:
        return self.sized.groupBy("_lw_doc").count().filter("count > 1").isEmpty()


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) a row of `docs`; options as for Mix."""
    return Mix(docs, **options).taken()
