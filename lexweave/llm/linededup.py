"""Cross-site line dedup by distinct-site spread, in DataFrame functions only.

A first aggregation by line hash keeps counts and the least and greatest site hash, which rules out lines
of one site or of too few rows at once. For the rest, HyperLogLog sketches of the sites merge by
aggregation; lines whose estimate lies near the threshold get an exact distinct count. Lines on
`min_sites` sites or more are boilerplate: their first occurrence (smallest id, then position) stays and
every other one goes. Time is linear in a text's lines, however many go.

Defined results: lines are split at \\n and compared whole; lines under `min_words` words never count. A
null text stays null and loses nothing; a null site counts as no site. A document that loses lines keeps
the rest in order. Rows with the same id and text count as the same document. An empty table gives an
empty table. Other columns pass through; clashing ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.hotjoin import join_hot
from lexweave.staging import stage


def _lines(docs: DataFrame, text: str, id_col: str, site: str, min_words: int) -> DataFrame:
    """One row a line of enough words: document key, id, position, line hash, site."""
    long_enough = rf"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{{min_words - 1}}}[^\x20\x09-\x0D]"
    # the key of a document is made before its lines are exploded: after it, each line would hash the whole text again
    keyed = docs.select(F.xxhash64(id_col, text).alias("_lw_doc"), F.col(id_col).alias("_lw_id"), F.col(site).alias("_lw_site"), F.split(text, "\n").alias("_lw_lines"))
    split = keyed.select("_lw_doc", "_lw_id", "_lw_site", F.posexplode("_lw_lines").alias("_lw_pos", "_lw_line"))
    return split.filter(F.col("_lw_line").rlike(long_enough)).withColumn("_lw_h", F.xxhash64("_lw_line")).drop("_lw_line")


def _weight(keys: DataFrame) -> int:
    return keys.agg(F.sum("_lw_n")).first()[0] or 0


def boilerplate(lines: DataFrame, min_sites: int = 5, near: float = 0.5, lg_k: int = 12) -> DataFrame:
    """Hashes of lines on `min_sites` sites or more, with how often they occur, their site count and first occurrence.

    `lines` should be staged, as it is read several times. Lines that hold many of the rows are joined apart.
    """
    site = F.xxhash64("_lw_site")
    first = F.min(F.struct(F.col("_lw_id").isNull().alias("no_id"), F.col("_lw_id").alias("id"), F.col("_lw_pos").alias("pos"), F.col("_lw_doc").alias("doc")))
    lo, hi = F.min(F.when(F.col("_lw_site").isNotNull(), site)), F.max(F.when(F.col("_lw_site").isNotNull(), site))
    wide = lines.groupBy("_lw_h").agg(F.count(F.lit(1)).alias("_lw_n"), F.count("_lw_site").alias("sited"), lo.alias("lo"), hi.alias("hi"))
    wide = stage(wide.filter((F.col("sited") >= min_sites) & ((F.col("lo") != F.col("hi")) | F.lit(min_sites <= 1))).select("_lw_h", "_lw_n"), "wide-lines")
    candidates = join_hot(lines.filter(F.col("_lw_site").isNotNull()), wide, "_lw_h", "_lw_n", _weight(wide)).withColumn("_lw_s", site)
    sketched = candidates.groupBy("_lw_h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_lw_s", F.lit(lg_k))).alias("about"), F.first("_lw_n").alias("_lw_n"))
    sketched = stage(sketched, "site-sketches")
    close = stage(sketched.filter(F.col("about").between(int(min_sites * (1 - near)), int(min_sites * (1 + near)) + 1)).select("_lw_h", "_lw_n"), "near-lines")
    near_rows = join_hot(lines.filter(F.col("_lw_site").isNotNull()), close, "_lw_h", "_lw_n", _weight(close))
    exact = near_rows.select("_lw_h", "_lw_site").distinct().groupBy("_lw_h").agg(F.count(F.lit(1)).alias("exact"))
    spread = sketched.join(exact, "_lw_h", "left").withColumn("sites", F.coalesce("exact", "about")).filter(F.col("sites") >= min_sites).select("_lw_h", "_lw_n", "sites")
    spread = stage(spread, "spread-lines")
    firsts = join_hot(lines, spread, "_lw_h", "_lw_n", _weight(spread)).groupBy("_lw_h").agg(first.alias("first"), F.first("_lw_n").alias("_lw_n"), F.first("sites").alias("sites"))
    return stage(firsts.select("_lw_h", "_lw_n", "sites", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos")), "boilerplate")


def _without(lines: Column, gone: Column) -> Column:
    """`lines` without those at the sorted places `gone`: the stretches between them, in one pass."""
    befores = F.concat(F.array(F.lit(-1)), gone)
    afters = F.concat(gone, F.array(F.size(lines)))
    return F.flatten(F.zip_with(befores, afters, lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", site: str = "source", min_sites: int = 5, min_words: int = 5) -> DataFrame:
    """`docs` with `text` cleaned, n_lines (lines of the old text) and n_removed_lines."""
    lines = stage(_lines(docs, text, id_col, site, min_words), "site-lines")
    spread = boilerplate(lines, min_sites)
    doomed = join_hot(lines, spread, "_lw_h", "_lw_n", _weight(spread)).filter((F.col("_lw_doc") != F.col("first_doc")) | (F.col("_lw_pos") != F.col("first_pos")))
    doomed = stage(doomed.groupBy("_lw_doc").agg(F.sort_array(F.collect_set("_lw_pos")).alias("_lw_gone")), "doomed-lines")
    # the doomed lines grow with the documents: they are never broadcast, whatever their size now
    out = docs.drop("n_lines", "n_removed_lines").withColumn("_lw_doc", F.xxhash64(id_col, text)).join(doomed.hint("merge"), "_lw_doc", "left")
    # the lines and their doomed places are bound as elements, so that they are made once a text
    bound = F.array(F.struct(F.split(text, "\n").alias("lines"), F.col("_lw_gone").alias("gone")))
    kept = F.transform(bound, lambda x: F.array_join(_without(x["lines"], x["gone"]), "\n"))[0]
    return out.withColumns(
        {
            "n_lines": F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("bigint"),
            "n_removed_lines": F.coalesce(F.size("_lw_gone"), F.lit(0)).cast("bigint"),
            text: F.when(F.col("_lw_gone").isNull(), F.col(text)).otherwise(kept),
        }
    ).drop("_lw_doc", "_lw_gone")
