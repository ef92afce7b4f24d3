"""Sharding by sampled splitters, in DataFrame functions only.

A record's key is a hash of its text. Size-weighted sampling draws keys, their quantiles become the splitters of
many small ranges, and exact sizes per range are then summed. An overfull range is subdivided: a text that alone
overfills a range (`heavy` fair shares of it or more) is spread over cells of its own by the hash of its ids,
and by a row number where one id repeats as well; what else the range holds is divided by a hash of the text,
so every other text stays whole. Runs of neighbouring cells make up the shards, so shard sizes differ by about
one cell. The keyed rows are staged once, without their texts unless these are asked for. The number of
ranges follows the number of rows up to `most_ranges`, which bounds the splitters and the sample that one task
sorts; beyond it ranges grow, and numbering them sorts on disk.

Defined results: a null text has size 1 and checksum 0, and shares its group with empty texts; rows with a null
id are placed like others. Repeated rows each get a slot of their own. An empty table gives an empty table.
Other columns pass through as far as they are kept; clashing ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexweave.staging import stage

OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Splitters are looked up by the key's leading bits: one row a bucket.
BUCKET_BITS = 12


def splitters(keyed: DataFrame, ranges: int, total: int, oversample: int = 16, seed: int = 11) -> DataFrame:
    """(cut, i): distinct keys at the quantiles of a size-weighted sample of about ranges * oversample rows, numbered from 1."""
    rate = ranges * oversample / max(total, 1)
    draw = F.pmod(F.xxhash64("_lw_k1", "_lw_k2", "_lw_row", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    copies = F.floor(F.col("size") * F.lit(rate) + draw).cast("bigint")
    sample = keyed.select("_lw_k1", copies.alias("n")).filter("n > 0").groupBy("_lw_k1").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.orderBy("_lw_k1"))  # the sample alone, ranges * oversample keys at most
    cuts = sample.select("_lw_k1", upto.alias("upto"), "n").filter(F.floor(F.col("upto") / oversample) > F.floor((F.col("upto") - F.col("n")) / oversample))
    return stage(cuts.select(F.col("_lw_k1").alias("cut"), F.row_number().over(W.orderBy("_lw_k1")).alias("i")), "cuts")


def range_of(df: DataFrame, key: str, cuts: DataFrame, out: str) -> DataFrame:
    """Add `out`: the number of cuts at or below the key, from a table of the cuts in each bucket of leading bits."""
    bucket = lambda c: F.shiftright(c, 64 - BUCKET_BITS)
    filled = cuts.groupBy(bucket(F.col("cut")).alias("_lw_bucket")).agg(F.array_sort(F.collect_list("cut")).alias("_lw_cuts"), F.max("i").alias("last"))
    every = df.sparkSession.range(-(1 << (BUCKET_BITS - 1)), 1 << (BUCKET_BITS - 1)).select(F.col("id").alias("_lw_bucket"))
    before = F.max("last").over(W.orderBy("_lw_bucket").rowsBetween(W.unboundedPreceding, -1))
    buckets = every.join(filled, "_lw_bucket", "left").select("_lw_bucket", "_lw_cuts", F.coalesce(before, F.lit(0)).alias("_lw_before"))
    # 2^BUCKET_BITS rows and one number a range: a bound that holds for every input
    joined = df.withColumn("_lw_bucket", bucket(F.col(key)).cast("bigint")).join(F.broadcast(stage(buckets, "cut-buckets")), "_lw_bucket")
    inside = F.coalesce(F.size(F.filter("_lw_cuts", lambda c: c <= F.col(key))), F.lit(0))
    return joined.withColumn(out, (F.col("_lw_before") + inside).cast("int")).drop("_lw_bucket", "_lw_cuts", "_lw_before")


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def _subdivided(ranged: DataFrame, fair_bytes: float, fair_rows: float, heavy: float) -> DataFrame:
    """Add the cell's other coordinates: `_lw_t`, the heavy text's key or null, and `_lw_p`, a part's number."""
    b, n = F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")
    shares = F.greatest(F.col("b") / fair_bytes, F.col("n") / fair_rows)
    over = shares >= heavy
    crowded = stage(ranged.groupBy("_lw_r").agg(b, n).filter(over).select("_lw_r", F.ceil(shares).cast("int").alias("_lw_rp")), "crowded")
    in_crowded = ranged.join(F.broadcast(crowded), "_lw_r")  # fewer rows than ranges
    texts = stage(in_crowded.groupBy("_lw_k1").agg(b, n).filter(over).select("_lw_k1", F.ceil(shares).cast("int").alias("_lw_tp")), "heavy-texts")
    # each holds a fair share of the bytes or of the rows: fewer than two a range
    twins = in_crowded.join(F.broadcast(texts), "_lw_k1", "left_semi").groupBy("_lw_k1", "_lw_k2").agg(b, n).filter(shares >= 1).select("_lw_k1", "_lw_k2", F.lit(True).alias("_lw_twin"))
    twins = stage(twins, "heavy-twins")
    known = ranged.join(F.broadcast(crowded), "_lw_r", "left").join(F.broadcast(texts), "_lw_k1", "left").join(F.broadcast(twins), ["_lw_k1", "_lw_k2"], "left")
    spread = F.when(F.col("_lw_twin"), F.xxhash64("_lw_row")).otherwise(F.col("_lw_k2"))
    part = F.when(F.col("_lw_tp").isNotNull(), F.pmod(spread, F.col("_lw_tp"))).when(F.col("_lw_rp").isNotNull(), F.pmod(F.xxhash64("_lw_k1", F.lit(13)), F.col("_lw_rp"))).otherwise(0)
    return known.withColumns({"_lw_t": F.when(F.col("_lw_tp").isNotNull(), F.col("_lw_k1")), "_lw_p": part.cast("int")}).drop("_lw_rp", "_lw_tp", "_lw_twin")


def shard_records(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, rows_per_range: int = 20_000, least_ranges: int = 1_024, most_ranges: int = 65_536, oversample: int = 16, heavy: float = 4.0) -> DataFrame:
    """The columns `keep` (all, if None) with size, text_crc32, law ('bytes'), shard, slot (gapless in the shard) and grown_shard (null)."""
    filled = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in OWN]
    own = {"size": record_size(F.col(text)), "text_crc32": F.crc32(filled), "_lw_k1": F.xxhash64(filled), "_lw_k2": F.xxhash64(F.col(id_col), F.lit(7)), "_lw_row": F.monotonically_increasing_id()}
    keyed = stage(docs.select(*[docs[c] for c in kept], *[c.alias(n) for n, c in own.items()]), "keyed")
    whole = keyed.agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).first()
    total = whole["bytes"] or 0
    ranges = min(most_ranges, max(least_ranges, -(-whole["rows"] // rows_per_range)))
    ranged = range_of(keyed, "_lw_k1", splitters(keyed, ranges, total, oversample), "_lw_r")
    celled = _subdivided(ranged, max(1.0, total / ranges), max(1.0, whole["rows"] / ranges), heavy)

    cell = ["_lw_r", "_lw_t", "_lw_p"]
    cells = stage(celled.groupBy(*cell).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")), "cells")
    before = W.orderBy(*cell).rowsBetween(W.unboundedPreceding, -1)  # over cells, not over records
    middle = F.coalesce(F.sum("b").over(before), F.lit(0)) + F.col("b") / 2
    placed = cells.withColumn("shard", F.least(F.floor(middle * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int"))
    in_shard = W.partitionBy("shard").orderBy(*cell).rowsBetween(W.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("_lw_base")
    placed = stage(placed.select("_lw_r", F.coalesce("_lw_t", F.lit(0)).alias("_lw_t"), F.col("_lw_t").isNotNull().alias("_lw_h"), "_lw_p", "shard", base), "placed")

    keyed_cells = celled.withColumns({"_lw_h": F.col("_lw_t").isNotNull(), "_lw_t": F.coalesce("_lw_t", F.lit(0))})
    cell = ["_lw_r", "_lw_t", "_lw_h", "_lw_p"]
    numbered = keyed_cells.withColumn("_lw_i", F.row_number().over(W.partitionBy(*cell).orderBy("_lw_k1", "_lw_k2", "_lw_row")))
    out = numbered.join(placed, cell)
    out = out.withColumns({"law": F.lit("bytes"), "slot": (F.col("_lw_base") + F.col("_lw_i") - 1).cast("bigint"), "grown_shard": F.lit(None).cast("int")})
    return out.select(*kept, *OWN)
