"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and tokenization.

Each stage takes the documents its predecessor kept and returns the columns of documents; the last returns
tokens. Null texts, empty tables and repeated rows are treated as the operators define. Extra columns pass
through up to the last stage; columns whose names clash with added ones are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import bpe, linededup, mixing, neardup, quality
from lexweave.staging import stage


def _packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that a stage reads, and all others in one, so that none clashes with what an operator adds."""
    rest = [c for c in docs.columns if c not in needed]
    return docs.select(*[c for c in needed if c in docs.columns], (F.struct(*rest) if rest else F.lit(None)).alias("_lw_rest"))


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    return packed.select(*[packed[c] if c in packed.columns else F.col(f"_lw_rest.`{c}`").alias(c) for c in docs.columns])


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule themselves and are on no bad host.

    The rules run once: their verdicts are staged with the documents, without the texts that fail anyway.
    """
    packed = _packed(docs, "text", "source")
    judged = quality.quality_features(packed).select(*packed.columns, "base_failed")
    judged = stage(judged.withColumn("text", F.when(~F.col("base_failed"), F.col("text"))), "judged")
    hosts = quality.host_verdicts(judged.select("source", "base_failed"))
    return _unpacked(quality.apply_verdicts(judged, hosts).filter("kept").select(*packed.columns), docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site lines; documents that consisted of nothing else go."""
    packed = _packed(docs, "doc_id", "text", "source", "n_chars")
    cleaned = linededup.dedup_lines(packed)
    touched = F.col("n_removed_lines") > 0
    left = cleaned.filter(~touched | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _unpacked(_counted(left, touched).select(*packed.columns), docs)


def _counted(docs: DataFrame, changed: Column) -> DataFrame:
    """n_chars follows the text where that has changed, if the documents have that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more."""
    return neardup.keep_one(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents, one row for each time a document is drawn from."""
    return _counted(mixing.Mix(docs).documents(), F.lit(True)).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number, and the digests of the ids and of the decoded bytes."""
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("quality rules", drop_low_quality),
    ("line dedup", drop_boilerplate),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix),
    ("byte-level BPE", tokenize),
]

#: Fingerprints, permutations and BPE are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
