"""Dictionary matches over texts that arrive in chunks.

The state of a text is the tail that a match may still begin in (one character less than the longest pattern), how
much was read in code points, bytes and UTF-16 units, what a match kind carries on (where it may begin again, and
for leftmost kinds the best hit of each start that isn't sure yet), and chunks that came before their turn, one
entry each. A match across chunks is reported once, as soon as it is sure. Chunks are numbered from 0 within a
text; a repeated one is ignored.

A text ends with the chunk marked `last`, or when no chunk of it has come for `timeout`: hits that were still open
are reported and its state is deleted, early chunks included. A chunk that comes later opens a new text of that
id: chunk 0 begins it, any other waits for its turn until the timeout. Without a timeout only the mark ends a text.

Texts are dealt into BUCKETS buckets, so that a call, its frames and its questions to the state serve many texts. The
state of a text, and its early chunks, are entries of their own in the bucket's maps.

The state is kept by transformWithState, which needs the RocksDB state store. With a timeout a query runs until it is
stopped: Spark goes on with batches for the timers, also under the trigger availableNow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lexweave.operators.matching import KINDS, ROWS_AT_ONCE, Leftmost, Units, check_size, find
from lexweave.session import send_value, sent_value, ship

HIT = "start long, end long, surface_id int, start_byte long, end_byte long, start_utf16 long, end_utf16 long"
MATCH = "note_id long, start long, end long, surface_id int, surface string, start_byte long, end_byte long, start_utf16 long, end_utf16 long"
PROGRESS = f"tail string, total long, total_byte long, total_utf16 long, due long, begin long, any_yet boolean, open array<struct<{HIT.replace(' long', ':long').replace(' int', ':int')}>>, ends_at long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BUCKETS = 1 << 11  # a batch's chunks of one bucket are handled together, each text with a state of its own


class ChunkScan(StatefulProcessor):
    """The scan of the texts of a bucket, by match kind."""

    def __init__(self, words: str, kind: str, timeout_ms: int | None) -> None:
        self.name, self.kind, self.timeout_ms = words, kind, timeout_ms

    @property
    def words(self) -> tuple[str, ...]:
        return sent_value(self.name)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.widest = None  # the words' file is not there yet when Spark asks for the states' schemas
        self.progress = handle.getMapState("progress", "note string", PROGRESS)
        self.early = handle.getMapState("early", "note string, chunk_no long", "text string, last boolean")

    def _fold(self, kept: list[tuple], text: str, due: int, was: int) -> list[tuple]:
        """Hits that are sure after `text`, whose first `was` characters are the tail; `kept` is progress, changed in place."""
        words = self.words
        tail, total, total_byte, total_utf16, begin, any_yet, held = kept
        units, base = Units(text), total - was
        before_byte, before_utf16 = (total_byte - units(0, was)[1], total_utf16 - units(0, was)[3])

        def placed(h: tuple) -> tuple:
            a, b, c, d = units(h[0], h[1])
            return base + h[0], base + h[1], h[2], before_byte + a, before_byte + b, before_utf16 + c, before_utf16 + d

        scan = "overlapping" if self.kind != "longest_per_end" else self.kind
        fresh = [placed(h) for h in find(words, text, scan) if h[1] > was or due == 0]
        if self.widest is None:
            self.widest = max(map(len, words), default=0)
        widest = self.widest
        ends = units(0, len(text))
        total, total_byte, total_utf16 = base + len(text), before_byte + ends[1], before_utf16 + ends[3]
        keep = min(max(widest - 1, 0), len(text))
        sure = []
        if self.kind.startswith("leftmost"):
            fold = Leftmost(self.kind == "leftmost_first", begin, any_yet, held)
            for h in fresh:
                fold.add(h)
            sure = list(fold.settle(total - widest + 1))
            begin, any_yet, held = fold.at, fold.any_yet, [h for s, h in fold.best.items() if s >= fold.at]
        elif self.kind == "nonoverlap" and "" in words:
            sure = [h for h in fresh if h[2] == words.index("")]
        elif self.kind == "nonoverlap":
            for h in fresh:
                if h[0] >= begin:
                    sure.append(h)
                    begin = h[1]
        else:
            sure = fresh
        kept[:] = [text[len(text) - keep :], total, total_byte, total_utf16, begin, any_yet, held]
        return sure

    def _open(self, kept: list) -> list[tuple]:
        """What is left when a text ends."""
        return list(Leftmost(self.kind == "leftmost_first", kept[4], kept[5], kept[6]).settle(kept[1] + 1))

    def _rows(self, hits: list[tuple]) -> pd.DataFrame:
        words = self.words
        rows = pd.DataFrame([(int(note) if note else None, h[0], h[1], h[2], words[h[2]], *h[3:]) for note, h in hits], columns=[c.split()[0] for c in MATCH.split(", ")])
        return rows.astype({"note_id": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came: dict[str, dict[int, tuple[str, bool]]] = {}
        for batch in rows:
            for note, no, text, last in zip(batch["note"], batch["chunk_no"], batch["text"], batch["last"], strict=True):
                came.setdefault(note, {}).setdefault(int(no), (text or "", bool(last)))
        known, ends_at = self.progress.exists(), None
        if self.timeout_ms is not None:
            ends_at = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
        hits: list[tuple] = []
        left: set[int] = set()
        for note in list(came):
            state = self.progress.getValue((note,)) if known and self.progress.containsKey((note,)) else None
            hits += [(note, h) for h in self._text(note, state, came.pop(note), ends_at)]
            if state is not None:
                left.add(state[-1])
            if len(hits) >= ROWS_AT_ONCE:
                yield self._rows(hits)
                hits = []
        if self.timeout_ms is not None:
            due = {p[-1] for p in self.progress.values()}
            if ends_at in due:
                self.handle.registerTimer(ends_at)
            for at in left - due - {None}:
                self.handle.deleteTimer(at)
        yield self._rows(hits)

    def _text(self, note: str, state: tuple | None, came: dict[int, tuple[str, bool]], ends_at: int | None) -> list[tuple]:
        """What is sure of one text with its new chunks; its state is kept or deleted."""
        kept, due = ["", 0, 0, 0, 0, False, []], 0
        if state is not None:
            tail, total, total_byte, total_utf16, due, begin, any_yet, held, _ = state
            kept = [tail, total, total_byte, total_utf16, begin, any_yet, [tuple(h) for h in held or []]]
        waits = state is not None and self.early.exists()  # chunks wait only for texts with a state
        hits: list[tuple] = []
        ended = False
        while not ended:
            if waits and self.early.containsKey((note, due)):
                text, ended = self.early.getValue((note, due))
                self.early.removeKey((note, due))
            elif due in came:
                text, ended = came[due]
            else:
                break
            hits += self._fold(kept, kept[0] + text, due, len(kept[0]))
            due += 1
        if ended:
            hits += self._open(kept)
            if state is not None:
                self._clear(note)
            return hits
        for no, chunk in came.items():
            if no > due and not (waits and self.early.containsKey((note, no))):
                self.early.updateValue((note, no), chunk)
        tail, total, total_byte, total_utf16, begin, any_yet, held = kept
        self.progress.updateValue((note,), (tail, total, total_byte, total_utf16, due, begin, any_yet, held, ends_at))
        return hits

    def _clear(self, note: str) -> None:
        self.progress.removeKey((note,))
        for k in [tuple(k) for k in self.early.keys()] if self.early.exists() else []:
            if k[0] == note:
                self.early.removeKey(k)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, hits = expiredTimerInfo.getExpiryTimeInMs(), []
        ended = [(n[0], tuple(p)) for n, p in self.progress.iterator() if p[-1] is not None and p[-1] <= until] if self.progress.exists() else []
        for note, (tail, total, total_byte, total_utf16, _, begin, any_yet, held, _) in ended:
            hits += [(note, h) for h in self._open([tail, total, total_byte, total_utf16, begin, any_yet, [tuple(h) for h in held or []]])]
            self._clear(note)
        yield self._rows(hits)

    def close(self) -> None:
        pass


def chunk_matches(chunks: DataFrame, patterns: list[str], kind: str = "overlapping", timeout_ms: int | None = None) -> DataFrame:
    """Matches of a stream of (note_id, chunk_no, text, and `last` if there is an end mark), by position in the whole text, in append mode."""
    if kind not in KINDS:
        raise ValueError(f"match kind must be one of {KINDS}")
    check_size(patterns)
    ship(chunks.sparkSession)
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    words = send_value(chunks.sparkSession, tuple(patterns))
    last = F.coalesce(F.col("last").cast("boolean"), F.lit(False)) if "last" in chunks.columns else F.lit(False)
    note = F.coalesce(F.col("note_id").cast("string"), F.lit("")).alias("note")
    bucket = F.pmod(F.xxhash64("note_id"), F.lit(BUCKETS)).alias("bucket")
    rows = chunks.select(bucket, note, F.col("chunk_no").cast("bigint").alias("chunk_no"), "text", last.alias("last"))
    return rows.groupBy("bucket").transformWithStateInPandas(ChunkScan(words, kind, timeout_ms), MATCH, "Append", "ProcessingTime" if timeout_ms is not None else "None")


def scan_files(path: str, patterns: list[str], out: str, kind: str = "overlapping") -> DataFrame:
    """Matches of the chunks in a folder of Parquet files (note_id, chunk_no, text, last), read as a stream until all are done."""
    spark = SparkSession.active()
    stream = spark.readStream.schema("note_id long, chunk_no long, text string, last boolean").parquet(path)
    sink = chunk_matches(stream, patterns, kind).writeStream.format("parquet").option("path", f"{out}/matches").option("checkpointLocation", f"{out}/progress")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(MATCH).parquet(f"{out}/matches")
