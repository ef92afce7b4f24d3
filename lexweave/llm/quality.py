"""Quality rules with host verdicts, in DataFrame functions only.

Per document the rules count words, symbols, repeated lines and repeated five-word windows. Failures are
then aggregated by host, each host's failure rate is shrunk with a beta prior fitted to all hosts, and the
verdict on the host is joined back to its documents. The host table holds one row a host; it is staged, so
the planner sees its true size and broadcasts it only below spark.sql.autoBroadcastJoinThreshold, with a
shuffled join otherwise.

Defined results: a null text counts as empty and fails (no words). A document without a host gets no host
verdict and counts for none. Repeated rows are judged alike and count as often as they occur. An empty
table gives an empty table. Columns of the input that clash with the added ones are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.staging import stage

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda rest, c: F.replace(rest, F.lit(c), F.lit("")), characters, text)


def repeated_window_words(df: DataFrame, words: str, out: str, window: int = 5) -> DataFrame:
    """Add `out`: words within windows of `window` words that occur twice or more in the row.

    Windows become 64-bit hashes; sorting them with their positions puts equal ones side by side. The
    covered words are then the sum of the gaps between repeated positions, `window` at most each.
    """
    every = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, window)]))
    df = df.withColumn("_lw_h", F.slice(every, 1, F.greatest(F.size(words) - (window - 1), F.lit(0))))
    df = df.withColumn("_lw_s", F.when(F.size(F.array_distinct("_lw_h")) < F.size("_lw_h"), F.sort_array(F.transform("_lw_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twins = F.filter("_lw_s", lambda s, k: (s["h"] == F.get("_lw_s", k - 1)["h"]) | (s["h"] == F.get("_lw_s", k + 1)["h"]))
    df = df.withColumn("_lw_d", F.sort_array(F.transform(twins, lambda s: s["i"])))
    gaps = F.zip_with("_lw_d", F.slice("_lw_d", 2, F.greatest(F.size("_lw_d"), F.lit(1))), lambda a, b: F.least(b - a, F.lit(window)))
    covered = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, gap: total + gap)
    return df.withColumn(out, F.when(F.col("_lw_s").isNull(), F.lit(0)).otherwise(covered).cast("bigint")).drop("_lw_h", "_lw_s", "_lw_d")


def quality_features(docs: DataFrame, text: str = "text", min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """`docs` with FEATURES and base_failed (too few words, or too many within repeated windows)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.drop(*FEATURES, "base_failed").withColumn("_lw_w", words_of(F.col(text))).withColumn("_lw_l", F.when(t.contains("\n"), lines))
    df = df.withColumns(
        {
            "n_words": F.size("_lw_w").cast("bigint"),
            "word_chars": F.length(_without(t, " \t\n\x0b\x0c\r")).cast("bigint"),
            "n_symbols": (F.length(t) - F.length(_without(t, SYMBOLS))).cast("bigint"),
            "n_dup_lines": F.coalesce(F.size("_lw_l") - F.size(F.array_distinct("_lw_l")), F.lit(0)).cast("bigint"),
        }
    )
    df = repeated_window_words(df, "_lw_w", "n_repeat_words").drop("_lw_w", "_lw_l")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def host_verdicts(judged: DataFrame, host: str = "source", max_rate: float = 0.5, default_strength: float = 100.0) -> DataFrame:
    """Per host: documents, failures, shrunk failure rate, and host_bad where that rate is over `max_rate`.

    The prior's mean and strength come from the mean and variance of the hosts' rates (method of moments);
    `default_strength` stands in where the rates don't vary.
    """
    hosts = judged.filter(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), F.count_if("base_failed").alias("host_failed"))
    hosts = stage(hosts, "hosts").withColumn("rate", F.col("host_failed") / F.col("host_docs"))
    prior = hosts.agg(F.avg("rate").alias("m"), F.var_samp("rate").alias("v")).first()
    m, v = prior["m"] or 0.0, prior["v"] or 0.0
    strength = m * (1 - m) / v - 1 if v > 0 else 0.0
    strength = strength if strength > 0 else default_strength
    rate = (F.col("host_failed") + F.lit(m * strength)) / (F.col("host_docs") + F.lit(strength))
    return hosts.select(host, "host_docs", "host_failed", rate.alias("host_rate")).withColumn("host_bad", F.col("host_rate") > max_rate)


def apply_verdicts(judged: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """`judged` with host_rate and kept: neither failed itself nor on a bad host."""
    joined = judged.drop("host_rate", "kept").join(verdicts.select(host, "host_rate", "host_bad"), host, "left")
    # one sum over both sides, null-tolerant: a filter on it, or one inferred from it, stays above the join
    # and never copies the rules' expressions
    faults = F.coalesce(F.col("base_failed").cast("int"), F.lit(1)) + F.coalesce(F.col("host_bad").cast("int"), F.lit(0))
    return joined.withColumn("kept", faults == 0).drop("host_bad")
