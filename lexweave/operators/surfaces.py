"""Surface forms: pages and redirects to surface rows, candidate lists, dense ids and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexweave.functions.text import qid_number, surface_key, surface_text
from lexweave.operators import graph, policy
from lexweave.staging import stage


def attach_qids(pages: DataFrame, props: DataFrame) -> DataFrame:
    """Article pages with the QID of their last wikibase_item row; null without one."""
    items = props.filter(F.col("propname") == "wikibase_item").groupBy("page_id").agg(F.max_by("value", "seq").alias("qid"))
    return pages.filter(F.col("namespace") == 0).select("wiki", "page_id", "title").join(items.hint("merge"), "page_id", "left")


def surface_sources(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """Titles and single-hop redirects with a QID, one row each; duplicate titles resolve to the least page id."""
    titled = pages.filter(F.col("qid").isNotNull()).select("wiki", "title", "qid", F.lit("page_title").alias("source"), "page_id", F.col("page_id").alias("target_page_id"))
    target = pages.groupBy("wiki", F.col("title").alias("target_title")).agg(F.min(F.struct("page_id", "qid")).alias("t"))
    hops = redirects.filter(F.col("namespace") == 0).join(pages.select("wiki", F.col("page_id").alias("source_page_id"), "title").hint("merge"), ["wiki", "source_page_id"]).join(target.hint("merge"), ["wiki", "target_title"])
    redirected = hops.filter(F.col("t.qid").isNotNull()).select("wiki", "title", F.col("t.qid").alias("qid"), F.lit("redirect").alias("source"), F.col("source_page_id").alias("page_id"), F.col("t.page_id").alias("target_page_id"))
    rows = titled.unionByName(redirected).withColumns({"surface_key": surface_key(F.col("title")), "surface_text": surface_text(F.col("title"))})
    rows = rows.filter(F.length("surface_key") > 0).groupBy("wiki", "surface_key", "qid", "source", "page_id").agg(F.min("surface_text").alias("surface_text"), F.min("target_page_id").alias("target_page_id"))
    return rows.select("wiki", "surface_key", "surface_text", "qid", "source", "page_id", "target_page_id")


def surface_qids(sources: DataFrame) -> DataFrame:
    """surface_key, its distinct QIDs in byte order, and their number."""
    lists = sources.filter(F.length("surface_key") > 0).groupBy("surface_key").agg(F.array_sort(F.collect_set("qid")).alias("qids"))
    return lists.withColumn("qid_count", F.size("qids"))


def dense_ids(rows: DataFrame, key: str, out: str, ranges: int | None = None) -> DataFrame:
    """`rows` (distinct keys) with 0-based positions in key order.

    Keys are range-partitioned and sorted; a partition's offset is the number of rows before it, so no task
    orders more than its own range. There are as many ranges as shuffle partitions, and 64 at least.
    """
    ranges = ranges or max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stage(rows.repartitionByRange(ranges, key).withColumn("_lw_p", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_lw_p").agg(F.count(F.lit(1)).alias("n"))  # `ranges` rows
    starts = sizes.select("_lw_p", F.coalesce(F.sum("n").over(W.orderBy("_lw_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_lw_start"))
    place = F.row_number().over(W.partitionBy("_lw_p").orderBy(key)) - 1
    return ranged.withColumn("_lw_i", place).join(F.broadcast(starts), "_lw_p").withColumn(out, (F.col("_lw_start") + F.col("_lw_i")).cast("bigint")).drop("_lw_p", "_lw_i", "_lw_start")


def list_offsets(lists: DataFrame, id_col: str, size: Column) -> DataFrame:
    """(id, offset, length): exclusive running sums of list sizes in id order, by ranges of ids."""
    bucket = (F.col(id_col) / 65536).cast("bigint")
    sized = lists.select(id_col, size.cast("bigint").alias("length"), bucket.alias("_lw_b"))
    before = sized.groupBy("_lw_b").agg(F.sum("length").alias("n"))
    starts = before.select("_lw_b", F.coalesce(F.sum("n").over(W.orderBy("_lw_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_lw_start"))
    inside = F.coalesce(F.sum("length").over(W.partitionBy("_lw_b").orderBy(id_col).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("_lw_i", inside).join(starts, "_lw_b").select(id_col, (F.col("_lw_start") + F.col("_lw_i")).alias("offset"), "length")


def ambiguity_summary(sources: DataFrame) -> DataFrame:
    """Per wiki: rows by source; and one row `*` with surfaces and ambiguous surfaces over all."""
    per = sources.groupBy("wiki").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("source") == "redirect").alias("redirects"), F.count_distinct("surface_key").alias("surfaces"), F.lit(0).cast("bigint").alias("ambiguous"))
    keys = surface_qids(sources).agg(F.count(F.lit(1)).alias("surfaces"), F.count_if(F.col("qid_count") > 1).alias("ambiguous"))
    total = sources.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("source") == "redirect").alias("redirects"))
    return per.unionByName(total.join(keys).select(F.lit("*").alias("wiki"), "rows", "redirects", "surfaces", "ambiguous"))  # one row by one row


def type_edges(claims: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, flags, targets) of candidates and of entities that carry flags or targets.

    `claims` has qid and targets (array of QID texts); flag bit 0 marks a disambiguation page.
    """
    numbers = F.array_sort(F.array_distinct(F.filter(F.transform("targets", qid_number), lambda n: n.isNotNull())))
    edges = claims.select(qid_number(F.col("qid")).alias("qid"), numbers.alias("targets")).filter(F.col("qid").isNotNull())
    edges = edges.groupBy("qid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("targets")))).alias("targets"))
    edges = edges.withColumn("flags", F.when(F.array_contains("targets", 4167410), 1).otherwise(0))
    seeds = candidates.select("qid").distinct().withColumn("is_candidate", F.lit(True))
    merged = edges.join(seeds.hint("merge"), "qid", "full").select("qid", F.coalesce("flags", F.lit(0)).alias("flags"), F.coalesce("targets", F.array().cast("array<bigint>")).alias("targets"), F.coalesce("is_candidate", F.lit(False)).alias("is_candidate"))
    return merged.filter(F.col("is_candidate") | (F.col("flags") != 0) | (F.size("targets") > 0)).drop("is_candidate")


def eid_lookup(qids: DataFrame, ids: DataFrame) -> DataFrame:
    """`qids` with their eid_id of `ids` (qid, eid_id); the job fails at one that isn't there."""
    joined = qids.join(ids, "qid", "left")
    known = F.when(F.col("eid_id").isNotNull(), F.col("eid_id")).otherwise(F.raise_error(F.concat(F.lit("unknown QID: Q"), "qid")))
    return joined.withColumn("eid_id", known)


def entity_cards(claims: DataFrame, candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """(qid, flags, colors) of every candidate: flags from its claims, and its distances to the anchors along all edges.

    The search also passes through entities that are no candidates.
    """
    edges = stage(type_edges(claims, candidates), "type-edges")
    steps = edges.select(F.col("qid").alias("source"), F.explode("targets").alias("target"))
    found = graph.cards(graph.anchor_distances(steps, anchors), candidates.select(F.col("qid").alias("node")))
    empty = F.array().cast("array<struct<anchor_id:int,distance:int>>")
    wanted = edges.join(candidates.select("qid").distinct().hint("merge"), "qid", "left_semi").select("qid", "flags")
    return wanted.join(found.withColumnRenamed("node", "qid").hint("merge"), "qid", "left").select("qid", "flags", F.coalesce("colors", empty).alias("colors"))


def entity_reports(claims: DataFrame, candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """(qid, report) of every candidate by the policy."""
    return entity_cards(claims, candidates, anchors).select("qid", policy.should_report(F.col("flags"), F.col("colors")).alias("report"))
