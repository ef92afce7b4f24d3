"""Continuous sync of notes: each micro-batch of changed notes becomes mentions, conflicts and rewritten texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lexweave.operators import notes as N
from lexweave.staging import released, stage


def sync_batch(notes: DataFrame, patterns: list[str], candidates: DataFrame, out: str, batch: int, folder: str = "wiki") -> None:
    """Write mentions, conflict matches and rewritten notes of one batch; a batch that is run again replaces itself."""
    with released():
        groups = stage(N.note_groups(notes, patterns, candidates, folder=folder), "mention-groups")
        mentions, matches = N.mentions_of(groups), N.conflict_matches_of(N.conflicts_of(groups))
        texts = N.render_notes(notes, N.replacements(mentions, matches, folder), folder=folder)
        for name, rows in (("mentions", mentions), ("conflict_matches", matches), ("notes", texts)):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")


def current(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The rows of table `name` as they stand: of each note those of its last batch, so what an older one said is replaced."""
    last = spark.read.parquet(f"{out}/notes").groupBy("note_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/{name}").join(last, ["note_id", "batch"]).drop("batch")


def sync_stream(notes: DataFrame, patterns: list[str], candidates: DataFrame, out: str, folder: str = "wiki") -> DataStreamWriter:
    """A writer for a stream of (note_id, text); the caller sets trigger and checkpoint and starts it."""
    return notes.writeStream.foreachBatch(lambda rows, batch: sync_batch(rows, patterns, candidates, out, batch, folder))
