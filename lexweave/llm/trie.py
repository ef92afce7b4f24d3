"""The trie of conversation prefixes, built from partial tries that merge by node key.

A turn becomes a 128-bit digest and a size, so that no text is shuffled. A node's key is its depth with two
64-bit sums (exclusive or) of the hashes of its turns with their places; as these sums are associative, they
run over blocks of turns, and no conversation has to fit in one task. Each partition combines its rows to a
table of nodes; these tables merge by node key, first within slots of partitions and then across them:
members add up, the least conversation stays. Ends merge as ranked lists of bounded length. The root, a hot
first turn or a conversation that very many share is met as partial sums only.

Rollup, bottom-up: the nodes that have the same least member form a downward path, and the paths form a tree
with a row a conversation. Totals of that tree come from pointer doubling, in as many rounds as the logarithm
of its height; along a path they are sums from the bottom, again over blocks.

Defined results: turns are ordered by turn, null first, ties by the digest of role and text, so repeated rows
count as often as they occur. A null role or text is empty. Rows without conversation belong to none. A
conversation without turns (after rebuild()) ends at the root. No conversation, no node: an empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.hotjoin import join_hot
from lexweave.session import ship
from lexweave.staging import stage

BLOCK, SLOTS = 4096, 32
NODE = "struct<depth:int,a:bigint,b:bigint>"


def _segments(df: DataFrame, by: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """`df` sorted over ranges of (by, order), with _lw_part and _lw_i, and for each (by, part) the place of its first row.

    A row's place within its `by` is `base` + _lw_i - `first`; a frequent `by` covers many ranges.
    """
    ranged = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("_lw_i", F.monotonically_increasing_id())
    rows = stage(ranged, name).withColumn("_lw_part", F.shiftright("_lw_i", 33))
    parts = rows.groupBy(by, "_lw_part").agg(F.count(F.lit(1)).alias("_lw_n"), F.min("_lw_i").alias("first"))
    whole = Window.partitionBy(by)
    before = whole.orderBy("_lw_part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, parts.select(by, "_lw_part", "first", F.coalesce(F.sum("_lw_n").over(before), F.lit(0)).alias("base"), F.sum("_lw_n").over(whole).alias("n"))


def _running(df: DataFrame, by: str, index: str, values: dict[str, tuple], reverse: bool = False) -> DataFrame:
    """Add running values along `index` in each `by`: name -> (column, aggregate, how two results combine); within blocks, then over blocks."""
    order = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    df = df.withColumn("_lw_block", F.expr(f"{index} div {BLOCK}"))
    sums = df.groupBy(by, "_lw_block").agg(*[f(c).alias(f"_lw_{name}") for name, (c, f, _) in values.items()])
    earlier = Window.partitionBy(by).orderBy(order("_lw_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(by, "_lw_block", *[f(f"_lw_{name}").over(earlier).alias(f"_lw_{name}") for name, (_, f, _) in values.items()])
    carried = carried.filter(F.col(f"_lw_{next(iter(values))}").isNotNull())
    within = Window.partitionBy(by, "_lw_block").orderBy(order(index)).rowsBetween(Window.unboundedPreceding, 0)
    ran = df.withColumns({name: f(c).over(within) for name, (c, f, _) in values.items()}).join(carried, [by, "_lw_block"], "left")
    return ran.withColumns({name: plus(F.col(name), F.coalesce(f"_lw_{name}", F.lit(0))) for name, (_, _, plus) in values.items()}).drop("_lw_block", *[f"_lw_{name}" for name in values])


def turn_keys(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, key (128 bits of role and text), bytes (UTF-8, of the text)."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256)
    return conversations.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("bigint").alias("conv"), F.col(turn).alias("turn"), F.unhex(F.substring(digest, 1, 32)).alias("key"), F.octet_length(t).cast("bigint").alias("bytes"))


def _placed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return rows.join(parts, ["conv", "_lw_part"]).withColumn("pos", F.col("base") + F.col("_lw_i") - F.col("first")).drop("_lw_part", "_lw_i", "base", "first", "turn")


def in_order(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as conv, depth (from 1), key, bytes, ends; and conversations with their number of turns."""
    rows, parts = _segments(keys, "conv", ["turn", "key"], "sorted-turns")
    turns = _placed(rows, parts).select("conv", (F.col("pos") + 1).cast("int").alias("depth"), "key", "bytes", (F.col("pos") + 1 == F.col("n")).alias("ends"))
    return turns, parts.select("conv", "n").distinct()


def rebuild(keys: DataFrame, group: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Like in_order(), with the first turns of each conversation replaced by those of another.

    Conversation c begins with the first h turns of c - c % group and goes on with its own after the first h,
    h being crc32 of its decimal id modulo most + 1.
    """
    rows, parts = _segments(keys, "conv", ["turn", "key"], "sorted-turns")
    parts = stage(parts, "turn-ranges")
    sizes = parts.select("conv", "n").distinct().withColumns({"h": F.crc32(F.col("conv").cast("string")) % (most + 1), "base_conv": F.expr(f"conv - conv % {group}")})
    bases = sizes.select(F.col("conv").alias("base_conv"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = sizes.join(bases, "base_conv", "left").select("conv", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("new_n"))
    plan = stage(plan, "rebuilding")

    placed = _placed(rows, parts.drop("n").join(plan, "conv"))
    own = placed.filter(F.col("pos") >= F.col("h")).withColumn("depth", F.col("taken") + F.col("pos") - F.col("h") + 1)
    near = F.expr(f"filter(transform(sequence({1 - group}, {group - 1}), k -> try_add(conv, k)), c -> c - c % {group} = conv)")
    first = placed.filter((F.col("pos") < most) & (F.col("conv") % group == 0)).select(F.explode(near).alias("conv"), "pos", "key", "bytes")
    head = first.join(plan, "conv").filter(F.col("pos") < F.col("h")).withColumn("depth", F.col("pos") + 1)
    both = own.select("conv", "depth", "key", "bytes", "new_n").unionByName(head.select("conv", "depth", "key", "bytes", "new_n"))
    return both.select("conv", F.col("depth").cast("int").alias("depth"), "key", "bytes", (F.col("depth") == F.col("new_n")).alias("ends")), plan.select("conv", F.col("new_n").alias("n"))


def _prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, node, parent, bytes, ends: a row for each turn, and one at the root for each conversation."""
    hashed = turns.withColumns({f"h{x}": F.xxhash64("key", "depth", F.lit(x)) for x in "ab"})
    ran = _running(hashed, "conv", "depth", {x: (f"h{x}", F.bit_xor, lambda m, n: m.bitwiseXOR(n)) for x in "ab"})
    node = F.struct("depth", "a", "b").cast(NODE)
    parent = F.struct((F.col("depth") - 1).alias("depth"), F.col("a").bitwiseXOR(F.col("ha")).alias("a"), F.col("b").bitwiseXOR(F.col("hb")).alias("b")).cast(NODE)
    above = F.when(F.col("depth") > 1, parent).otherwise(F.struct(F.lit(0), F.lit(0), F.lit(0)).cast(NODE))
    root = convs.select("conv", F.struct(F.lit(0), F.lit(0), F.lit(0)).cast(NODE).alias("node"), F.lit(None).cast(NODE).alias("parent"), F.lit(0).cast("bigint").alias("bytes"), (F.col("n") == 0).alias("ends"))
    return stage(ran.select("conv", node.alias("node"), above.alias("parent"), "bytes", "ends").unionByName(root), "prefixes")


def _merged(prefixes: DataFrame) -> DataFrame:
    """One row a node: parent, conv (least member), n (members), bytes. Partitions combine, slots of partitions merge, then slots."""
    tables = prefixes.select("node", "parent", "conv", F.lit(1).cast("bigint").alias("n"), "bytes", (F.spark_partition_id() % SLOTS).alias("slot"))
    for key in (("node", "slot"), ("node",)):
        tables = tables.groupBy(*key).agg(F.first("parent").alias("parent"), F.min("conv").alias("conv"), F.sum("n").alias("n"), F.max("bytes").alias("bytes"))
    return stage(tables, "nodes")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the lists of a node, which come in order; one list is held at a time."""
    def out(node: dict, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([node | {"ends_sha256": digest.hexdigest()}], pa.schema([("depth", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())]))

    at, digest = None, None
    for batch in batches:
        for row in batch.to_pylist():
            node = {k: row[k] for k in ("depth", "a", "b")}
            if node != at:
                if at is not None:
                    yield out(at, digest)
                at, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(row["list"].encode())
    if at is not None:
        yield out(at, digest)


def _ends(prefixes: DataFrame) -> DataFrame:
    """node, ends_sha256: of the decimal ids that end there, in order. Lists hold BLOCK ids at most; longer ones are digested list by list."""
    rows, parts = _segments(prefixes.filter("ends").select("node", "conv"), "node", ["conv"], "ends")
    ranked = rows.join(parts, ["node", "_lw_part"]).withColumn("list_no", F.expr(f"(base + _lw_i - first) div {BLOCK}"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    lists = stage(ranked.groupBy("node", "list_no").agg(joined.alias("list"), F.first("n").alias("n")), "end-lists")
    short = lists.filter(F.col("n") <= BLOCK).select("node", F.sha2("list", 256).alias("ends_sha256"))
    sorted_lists = lists.filter(F.col("n") > BLOCK).select("node.*", "list_no", "list").repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "list_no")
    long = sorted_lists.mapInArrow(_streamed, "depth int, a bigint, b bigint, ends_sha256 string")
    return short.unionByName(long.select(F.struct("depth", "a", "b").cast(NODE).alias("node"), "ends_sha256"))


def _path_totals(paths: DataFrame, values: list[str]) -> DataFrame:
    """`paths` (conv, ptr to the path it hangs on) with `values` summed over each path and all below it."""
    state, total = stage(paths.select("conv", "ptr", *values), "paths"), paths.count()
    while not state.filter("ptr IS NOT NULL").isEmpty():
        below = state.filter("ptr IS NOT NULL").groupBy(F.col("ptr").alias("conv")).agg(*[F.sum(v).alias(f"_lw_{v}") for v in values], F.count(F.lit(1)).alias("kids"))
        grown = state.join(below, "conv", "left").select("conv", "ptr", *[(F.col(v) + F.coalesce(f"_lw_{v}", F.lit(0))).alias(v) for v in values], "kids")
        grown = stage(grown, "paths")
        above = grown.filter("kids IS NOT NULL").select(F.col("conv").alias("ptr"), F.col("ptr").alias("next"), "kids")
        moved = join_hot(grown.filter("ptr IS NOT NULL").drop("kids"), above, "ptr", "kids", total)
        state = stage(moved.select("conv", F.col("next").alias("ptr"), *values).unionByName(grown.filter("ptr IS NULL").drop("kids")), "paths")
    return state.drop("ptr")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Per node conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    `turns` and `convs` are those of in_order() or rebuild().
    """
    ship(turns.sparkSession)
    prefixes = _prefixes(turns, convs)
    nodes = _merged(prefixes)
    kids = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    above = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv"), F.col("n_children").alias("_lw_kids"))
    below = join_hot(nodes.filter(F.col("parent").isNotNull()), above, "parent", "_lw_kids", nodes.count()).drop("_lw_kids")
    root = nodes.filter(F.col("parent").isNull()).withColumn("parent_conv", F.lit(None).cast("bigint"))
    own = {"saved": (F.col("n") - 1) * F.col("bytes"), "leaves": (F.col("n_children") == 0).cast("bigint")}
    nodes = stage(below.unionByName(root).drop("parent").withColumns({"depth": F.col("node.depth"), **own}), "nodes")

    top: Column = F.col("parent_conv") < F.col("conv")
    paths = nodes.groupBy("conv").agg(F.max(F.when(top, F.col("parent_conv"))).alias("ptr"), (F.min("depth") - 1).alias("hangs"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    paths = stage(paths, "paths")
    hung = paths.filter("ptr IS NOT NULL").select("conv", "ptr", "hangs").join(_path_totals(paths, ["saved", "leaves"]), "conv")
    hung = hung.groupBy(F.col("ptr").alias("conv"), F.col("hangs").alias("depth")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    all_at = nodes.join(hung, ["conv", "depth"], "left").withColumns({v: F.col(v) + F.coalesce(f"more_{v}", F.lit(0)) for v in ("saved", "leaves")})
    summed = _running(all_at, "conv", "depth", {f"all_{v}": (v, F.sum, lambda m, n: m + n) for v in ("saved", "leaves")}, reverse=True)

    out = summed.join(_ends(prefixes), "node", "left")
    return out.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("bigint").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("n_children").cast("bigint").alias("n_children"),
        F.col("all_leaves").alias("n_leaves"), F.col("all_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of `conversations` as they are."""
    return trie(*in_order(turn_keys(conversations)))


def rebuilt_trie(conversations: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """The trie of `conversations` whose first turns are shared within groups of ids."""
    return trie(*rebuild(turn_keys(conversations), group, most))
