"""Notes: pieces, dictionary matches with their surroundings, mentions and conflicts, and rewriting of links.

Scanning a note yields one row a match with everything that depends on the text around it; candidates, clusters,
decisions and counts are joins, windows and groupings over those small rows, so no note travels with its matches.
Where candidates are few enough to be sent to all workers, note_groups() yields the clusters themselves, since a
cluster lies within one segment of one note: then no match is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, groupby, islice
from json.encoder import encode_basestring

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexweave.functions.markdown import SPACE, Piece, pieces
from lexweave.operators.matching import ROWS_AT_ONCE, check_size, find
from lexweave.operators.mentions import clusters
from lexweave.operators.store import effective
from lexweave.session import ship

HASH_VERSION = "mention-conflict-v1"  # fixed value: part of stored hashes
CONTEXT_WEIGHT = 30
MOST_LISTED = 1_000_000  # surfaces and candidates that are broadcast
HAN = regex.compile(r"\p{Script=Han}")
SPACED = regex.compile(f"[{SPACE}]")
BLANKS = re.compile(f"[{SPACE}]+")
FEW = 8  # places of a text whose contexts are read one by one
SCRIPTS = regex.compile(r"[\p{Script=Han}\p{Script=Latin}]")
WORD_EDGE = regex.compile(r"\b", regex.WORD)
PIECE = "array<struct<syntax:string,text:string,start:int,end:int,eid:string,path:string>>"
PIECES = pa.list_(pa.struct([("syntax", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("eid", pa.string()), ("path", pa.string())]))
SHORT, MOST_SHORT = 200, 1024  # characters, and number, of the texts whose matches a worker keeps for those that come again
HIT = [("start", pa.int32()), ("end", pa.int32()), ("surface_id", pa.int32()), ("surface", pa.string()), ("source_start", pa.int32()), ("source_end", pa.int32()), ("eids", pa.list_(pa.string())), ("suspect", pa.bool_()), ("resolved_eid", pa.string())]
GROUP = "note_id long, segment_no int, cluster_no int, hits array<struct<start:int,end:int,surface_id:int,surface:string,source_start:int,source_end:int,eids:array<string>,suspect:boolean,resolved_eid:string>>, source_start int, source_end int, left_context string, right_context string, text string, kind string, hash string"
GROUP_HITS, GROUP_CHARACTERS = 200_000, 4_000_000  # hits, and characters, whose clusters are made together
KINDS = ("mention", "conflict")
MATCH = "note_id long, segment_no int, start int, end int, source_start int, source_end int, surface_id int, surface string, suspect boolean, link_eid string, link_path string, left_context string, right_context string"


def note_pieces(notes: DataFrame, id_col: str = "note_id", text: str = "text", folder: str = "wiki") -> DataFrame:
    """(note_id, piece_no, syntax, text, start, end, eid, path), one row a piece; a null note has none."""
    ship(notes.sparkSession)

    @F.arrow_udf(PIECE)
    def cut(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()  # a text that comes again in a batch is cut once
        each = [[p._asdict() for p in pieces(t, folder)] for t in coded.dictionary.to_pylist()]
        return pa.array(each, PIECES).take(coded.indices)

    return notes.select(F.col(id_col).alias("note_id"), F.posexplode(cut(text)).alias("piece_no", "p")).select("note_id", "piece_no", "p.*")


def segments(found: Iterable[Piece]) -> Iterator[list[Piece]]:
    """Runs of visible pieces; any syntax ends a run."""
    return (list(run) for visible, run in groupby(found, lambda p: p.syntax in ("text", "link")) if visible)


@cache
def weight(c: str) -> int:
    """0 for white space, 3 for Han, else 1."""
    return 0 if SPACED.match(c) else 3 if HAN.match(c) else 1


def context(outward: Iterable[str]) -> str:
    """Characters away from a match up to a weight (3 for Han, else 1); white space counts as one blank."""
    out, room, gap = [], CONTEXT_WEIGHT, False
    for c in outward:
        if room <= 0:
            break
        if not (w := weight(c)):
            gap = True
            continue
        if gap:
            out.append(" ")
            room -= 1
        out.append(c)
        room -= w
        gap = False
    return "".join(out) + (" " if gap and room > 0 else "")


_WEIGHTS = np.full(0x110000, 255, np.uint8)


def _weights(codes: np.ndarray) -> np.ndarray:
    """weight() of many characters, from a table that fills as they come."""
    found = _WEIGHTS[codes]
    if (new := found == 255).any():
        for c in np.unique(codes[new]).tolist():
            _WEIGHTS[c] = weight(chr(c))
        found = _WEIGHTS[codes]
    return found.astype(np.int64)


class Contexts:
    """context() rightwards from many places of one text: sums of weights tell where each ends."""

    def __init__(self, text: str) -> None:
        weights = _weights(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        self.size, self.shown = len(text), np.nonzero(weights)[0]
        self.gap = np.diff(self.shown, prepend=-1) > 1  # white space before a character that shows
        self.before = np.concatenate([[0], np.cumsum(weights[self.shown] + self.gap)])
        self.squeezed = BLANKS.sub(" ", text)
        self.at = np.arange(len(self.shown)) + np.cumsum(self.gap)  # places in `squeezed`

    def from_places(self, places: list[int]) -> list[str]:
        n, where = len(self.shown), np.array(places, np.int64)
        if not n:
            return [" " if p < self.size else "" for p in places]
        first = np.searchsorted(self.shown, where)
        some = np.minimum(first, n - 1)
        blank = self.shown[some] > where
        spent = self.before[some] + self.gap[some] - blank
        stop = np.searchsorted(self.before[:n], spent + CONTEXT_WEIGHT)
        open_end = (stop == n) & (self.shown[-1] < self.size - 1) & (self.before[n] - spent < CONTEXT_WEIGHT)
        ranges = zip(places, first.tolist(), (self.at[some] - blank).tolist(), (self.at[np.maximum(stop, 1) - 1] + 1).tolist(), open_end.tolist(), strict=True)
        return [(self.squeezed[a:b] + " " * more) if k < n else " " if p < self.size else "" for p, k, a, b, more in ranges]


def _contexts(text: str, starts: list[int], ends: list[int]) -> tuple[dict[int, str], dict[int, str]]:
    """context() to the left of each of `starts` and to the right of each of `ends`."""
    n = len(text)
    if len(starts) < FEW:
        return {a: context(text[j] for j in range(a - 1, -1, -1))[::-1] for a in starts}, {b: context(text[j] for j in range(b, n)) for b in ends}
    left = Contexts(text[::-1]).from_places([n - a for a in starts])
    return {a: c[::-1] for a, c in zip(starts, left, strict=True)}, dict(zip(ends, Contexts(text).from_places(ends), strict=True))


def segment_matches(words: tuple[str, ...], run: list[Piece]) -> Iterator[tuple]:
    """(start, end, source range, surface id and text, suspect, link, contexts) of each match in a segment."""
    text, starts, total = "".join(p.text for p in run), [], 0
    for p in run:
        starts.append(total)
        total += len(p.text)
    hits = [h for h in find(words, text, "overlapping") if h[0] < h[1]]
    if not hits:
        return
    edges = {0, total} | {m.start() for m in WORD_EDGE.finditer(text)}
    left, right = _contexts(text, list({h[0] for h in hits}), list({h[1] for h in hits}))
    for a, b, i in hits:
        k, last = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        first, final = run[k], run[last]
        source = (first.start if first.syntax == "link" else first.start + a - starts[k], final.end if final.syntax == "link" else final.start + b - starts[last])
        link = first if first.syntax == "link" and k == last else None
        suspect = not (a in edges and b in edges) and bool(SCRIPTS.search(text, a, b))
        yield (a, b, *source, i, words[i], suspect, link and link.eid, link and link.path, left[a], right[b])


def note_matches(notes: DataFrame, patterns: list[str], id_col: str = "note_id", text: str = "text", folder: str = "wiki") -> DataFrame:
    """Every dictionary match within a segment of a note; surface_id is the pattern's position."""
    check_size(patterns)
    ship(notes.sparkSession)
    shared = notes.sparkSession.sparkContext.broadcast(tuple(patterns))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, known = shared.value, {}

        def found(text: str) -> Iterable[tuple]:
            rows = ((n, *row) for n, run in enumerate(segments(pieces(text, folder))) for row in segment_matches(words, run))
            if len(text) > SHORT:
                return rows
            if text not in known:
                if len(known) >= MOST_SHORT:
                    known.clear()
                known[text] = list(rows)
            return known[text]

        for batch in batches:
            texts = zip(batch["note_id"], batch["text"], strict=True)
            rows = ((note, *row) for note, t in texts for row in found(t or ""))
            while some := list(islice(rows, ROWS_AT_ONCE)):
                yield pd.DataFrame(some, columns=[c.split()[0] for c in MATCH.split(", ")])

    return notes.select(F.col(id_col).alias("note_id"), F.col(text).alias("text")).mapInPandas(scan, MATCH)


def with_candidates(matches: DataFrame, candidates: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """`matches` with eids (of candidates: surface_id, eids) and resolved_eid, where an old link names one of them.

    `entities` (eid, view_path) names the entities of links that have no EID in their file name. Matches are never the
    side that is broadcast: the planner takes them for no larger than the notes' files.
    """
    listed = candidates.filter(F.size("eids") > 0).select("surface_id", "eids")
    n = listed.agg(F.sum(F.size("eids") + 1)).first()[0] or 0
    rows = matches.join(F.broadcast(listed) if n <= MOST_LISTED else listed.hint("merge"), "surface_id")
    if entities is not None:
        known = entities.select(F.col("view_path").alias("link_path"), F.col("eid").alias("path_eid")).dropDuplicates(["link_path"])
        rows = rows.join(known, "link_path", "left").withColumn("link_eid", F.coalesce("link_eid", "path_eid")).drop("path_eid")
    return rows.withColumn("resolved_eid", F.when(F.array_contains("eids", F.col("link_eid")), F.col("link_eid"))).drop("link_eid", "link_path")


def _joined_text(hits: Column) -> Column:
    """The text that sorted, overlapping hits cover, from their own surfaces."""
    begin = F.struct(F.lit("").alias("text"), hits[0]["start"].alias("end"))

    def add(done: Column, h: Column) -> Column:
        fresh = F.substr(h["surface"], done["end"] - h["start"] + 1)
        return F.struct(F.concat(done["text"], F.when(h["end"] > done["end"], fresh).otherwise("")).alias("text"), F.greatest(done["end"], h["end"]).alias("end"))

    return F.aggregate(hits, begin, add)["text"]


@F.pandas_udf(StringType())
def conflict_hash(left: pd.Series, text: pd.Series, right: pd.Series, surfaces: pd.Series, ids: pd.Series, eids: pd.Series) -> pd.Series:
    """SHA-256 of the compact JSON of a conflict's surroundings and candidates."""

    def one(a, t, b, words, numbers, lists) -> str:
        found = [{"text": w, "surfaceId": int(n), "eids": list(e)} for w, n, e in zip(words, numbers, lists, strict=True)]
        body = {"version": HASH_VERSION, "leftContext": a, "text": t, "rightContext": b, "matches": found}
        return hashlib.sha256(json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()

    return pd.Series([one(*row) for row in zip(left, text, right, surfaces, ids, eids, strict=True)], dtype=object)


def mention_groups(rows: DataFrame) -> DataFrame:
    """One row a cluster of overlapping matches: kind, text, source range, contexts, hits (in order).

    A cluster of one match with one candidate is a mention. Any other is a conflict of those hits that are
    resolved or no suspects, and none if there are no such hits.
    """
    key = ["note_id", "segment_no"]
    numbered = clusters(rows, key)
    hit = F.struct("start", "end", "surface_id", "surface", "source_start", "source_end", "eids", "suspect", "resolved_eid")
    wide = F.struct("end", "start")
    grouped = numbered.groupBy(*key, "cluster_no").agg(
        F.array_sort(F.collect_list(hit)).alias("hits"),
        F.min("source_start").alias("source_start"),
        F.max("source_end").alias("source_end"),
        F.min_by("left_context", "start").alias("left_context"),
        F.max_by("right_context", wide).alias("right_context"),
    )
    grouped = grouped.withColumn("text", _joined_text(F.col("hits")))
    sure = (F.size("hits") == 1) & (F.size(F.col("hits")[0]["eids"]) == 1)
    kept = F.filter("hits", lambda h: h["resolved_eid"].isNotNull() | ~h["suspect"])
    out = grouped.withColumn("kind", F.when(sure, "mention").otherwise("conflict")).withColumn("hits", F.when(sure, F.col("hits")).otherwise(kept))
    return out.filter(F.size("hits") > 0)


class _Listed:
    """The patterns with their candidates, as a worker reads them: by surface id."""

    def __init__(self, words: tuple[str, ...], eids: dict[int, list[str]]) -> None:
        self.words, self.eids = words, [eids.get(i, ()) for i in range(len(words))]
        self.texts, self.lists = pa.array(words, pa.string()), pa.array(self.eids, pa.list_(pa.string()))
        self.count = np.array([len(e) for e in self.eids], np.int64)
        self.scripted = np.array([bool(SCRIPTS.search(w)) for w in words], bool)
        self.coded: dict[int, str] = {}

    def json(self, i: int) -> str:
        """The pattern as conflict_hash() writes it."""
        if i not in self.coded:
            self.coded[i] = json.dumps({"text": self.words[i], "surfaceId": i, "eids": list(self.eids[i])}, ensure_ascii=False, separators=(",", ":"))
        return self.coded[i]


_LISTED: list[tuple] = [(None, None)]


def _listed(value: tuple) -> _Listed:
    """That of the broadcast value asked for last is kept."""
    if _LISTED[0][0] is not value:
        _LISTED[0] = (value, _Listed(*value))
    return _LISTED[0][1]


_SURE = np.zeros(257, np.uint8)  # 1 for letters of Latin-1 that never part from each other, 2 for white space, which always parts from them
_SURE[[c for c in range(256) if chr(c).isalpha() and c not in (0xAA, 0xB5, 0xBA)]] = 1
_SURE[[0x20, 0x0A]] = 2


def word_edges(text: str, places: np.ndarray) -> np.ndarray:
    """Those of `places` that are the text's ends or boundaries of words."""
    kinds = _SURE[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 256)]
    inner = (places > 0) & (places < len(text))
    before, behind = kinds[np.where(inner, places - 1, 0)], kinds[np.where(inner, places, 0)]
    edge = ~inner | (before + behind == 3)
    for k in np.nonzero(inner & ((before == 0) | (behind == 0) | (before + behind == 4)))[0].tolist():
        edge[k] = WORD_EDGE.match(text, int(places[k])) is not None
    return places[edge]


def _cut(listed: _Listed, text: str, folder: str) -> list[tuple]:
    """(segment_no, text, hits, edges, pieces' places and sources, pieces) of each segment with hits of patterns that have candidates."""
    out = []
    for n, run in enumerate(segments(pieces(text, folder))):
        shown = "".join(p.text for p in run)
        hits = np.fromiter(chain.from_iterable(find(listed.words, shown, "overlapping")), np.int64).reshape(-1, 3)
        hits = hits[(hits[:, 0] < hits[:, 1]) & (listed.count[hits[:, 2]] > 0)]
        if not len(hits):
            continue
        edges = word_edges(shown, np.unique(hits[:, :2]))
        sizes = np.cumsum([0, *(len(p.text) for p in run)])[:-1]
        places = np.stack([sizes, *np.array([(p.start, p.end, p.syntax == "link") for p in run], np.int64).T])
        out.append((n, shown, hits, edges, places, run))
    return out


class _Chunk:
    """Segments of some notes, laid one behind the other, whose clusters are made together."""

    def __init__(self) -> None:
        self.segments, self.bases, self.size, self.hits = [], [], 0, 0

    def add(self, note: int, cut: list[tuple]) -> None:
        for segment in cut:
            self.segments.append((note, *segment))
            self.bases.append(self.size)
            self.size += len(segment[1]) + 1
            self.hits += len(segment[2])

    def groups(self, listed: _Listed, kinds: tuple[str, ...], contexts: bool) -> pa.RecordBatch:
        notes, numbers, texts, hits, edges, places, runs = zip(*self.segments, strict=True)
        base = np.array(self.bases, np.int64)
        seg = np.repeat(np.arange(len(base)), [len(h) for h in hits])
        a, b, i = np.concatenate(hits).T
        a, b = a + base[seg], b + base[seg]
        order = np.lexsort((i, b, a))
        a, b, i, seg = a[order], b[order], i[order], seg[order]
        edge = np.zeros(self.size, bool)
        edge[np.concatenate([e + at for e, at in zip(edges, base.tolist(), strict=True)])] = True
        suspect = ~(edge[a] & edge[b]) & listed.scripted[i]

        # where a hit comes from: its place in a text, or the whole of a link
        pieces_of = [p for run in runs for p in run]
        at, begin, stop, link = np.concatenate(places, axis=1)
        at = at + np.repeat(base, [p.shape[1] for p in places])
        link = link.astype(bool)
        k, last = np.searchsorted(at, a, "right") - 1, np.searchsorted(at, b - 1, "right") - 1
        source_start = np.where(link[k], begin[k], begin[k] + a - at[k])
        source_end = np.where(link[last], stop[last], begin[last] + b - at[last])
        resolved = np.full(len(a), None, object)
        for n in np.nonzero(link[k] & (k == last))[0].tolist():
            eid = pieces_of[k[n]].eid
            if eid is not None and eid in listed.eids[i[n]]:
                resolved[n] = eid
        known = resolved != None  # noqa: E711 - by element

        # a cluster begins where all ends before are reached; segments lie apart
        fresh = np.concatenate([[True], a[1:] >= np.maximum.accumulate(b)[:-1]])
        first, group = np.nonzero(fresh)[0], np.cumsum(fresh) - 1
        own = seg[first]
        cluster_no = np.arange(len(first)) - np.searchsorted(own, own) + 1
        sure = (np.diff(first, append=len(a)) == 1) & (listed.count[i[first]] == 1)
        kept = sure[group] | known | ~suspect
        wanted = (np.add.reduceat(kept.astype(np.int64), first) > 0) & (sure if "conflict" not in kinds else ~sure if "mention" not in kinds else True)
        shown = np.nonzero(kept & wanted[group])[0]
        out = np.nonzero(wanted)[0]
        n_shown = np.bincount(group[shown], minlength=len(first))[out]
        reach = np.maximum.reduceat(b, first)
        ends = [np.minimum.reduceat(source_start, first)[out], np.maximum.reduceat(source_end, first)[out]]
        own, cluster_no, sure = own[out], cluster_no[out], sure[out]
        left_at, right_at = (a[first[out]] - base[own]).tolist(), (reach[out] - base[own]).tolist()
        whole = [texts[s][x:y] for s, x, y in zip(own.tolist(), left_at, right_at, strict=True)]

        offsets = np.concatenate([[0], np.cumsum(n_shown)])
        left, right, hashes = [None] * len(out), [None] * len(out), [None] * len(out)
        if contexts:
            ids = i[shown].tolist()
            open_ones = np.nonzero(~sure)[0]
            for some in np.split(open_ones, np.nonzero(np.diff(own[open_ones]))[0] + 1) if len(open_ones) else ():
                some = some.tolist()
                before, behind = _contexts(texts[own[some[0]]], [left_at[g] for g in some], [right_at[g] for g in some])
                for g in some:
                    x, y = left[g], right[g] = before[left_at[g]], behind[right_at[g]]
                    matches = ",".join([listed.json(n) for n in ids[offsets[g] : offsets[g + 1]]])
                    body = f'{{"version":"{HASH_VERSION}","leftContext":{encode_basestring(x)},"text":{encode_basestring(whole[g])},"rightContext":{encode_basestring(y)},"matches":[{matches}]}}'
                    hashes[g] = hashlib.sha256(body.encode()).hexdigest()

        surface, local = pa.array(i[shown]), base[seg[shown]]
        fields = [a[shown] - local, b[shown] - local, i[shown], listed.texts.take(surface), source_start[shown], source_end[shown], listed.lists.take(surface), suspect[shown], resolved[shown]]
        fields = [f if isinstance(f, pa.Array) else pa.array(f, kind) for f, (_, kind) in zip(fields, HIT, strict=True)]
        listing = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=[pa.field(*h) for h in HIT]))
        columns = [
            pa.array(np.array(notes, np.int64)[own]), pa.array(np.array(numbers)[own], pa.int32()), pa.array(cluster_no, pa.int32()), listing, *(pa.array(e, pa.int32()) for e in ends),
            pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(whole, pa.string()), pa.array(np.where(sure, "mention", "conflict"), pa.string()), pa.array(hashes, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in GROUP.split(", ")])


def note_groups(notes: DataFrame, patterns: list[str], candidates: DataFrame, entities: DataFrame | None = None, id_col: str = "note_id", text: str = "text", folder: str = "wiki", kinds: tuple[str, ...] = KINDS, contexts: bool = True) -> DataFrame:
    """The groups of mention_groups() over all matches with candidates, of the given kinds.

    Up to MOST_LISTED candidates go to all workers, and each note's clusters are made where it is scanned, with the hash of
    each conflict. Contexts are those of conflicts; without `contexts` they and hashes are null. More candidates, repeated
    surfaces and `entities` take the way over joined and grouped matches.
    """
    listed = candidates.filter(F.size("eids") > 0).select("surface_id", "eids")
    size = listed.agg(F.sum(F.size("eids") + 1).alias("n"), F.count("surface_id").alias("rows"), F.count_distinct("surface_id").alias("ids")).first()
    if entities is not None or (size["n"] or 0) > MOST_LISTED or size["ids"] < size["rows"]:
        matches = note_matches(notes, patterns, id_col, text, folder)
        return mention_groups(with_candidates(matches, candidates, entities)).filter(F.col("kind").isin(*kinds))
    check_size(patterns)
    ship(notes.sparkSession)
    shared = notes.sparkSession.sparkContext.broadcast((tuple(patterns), {r["surface_id"]: list(r["eids"]) for r in listed.collect()}))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, known, chunk = _listed(shared.value), {}, _Chunk()
        for batch in batches:
            for note, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t and len(t) <= SHORT:
                    if t not in known:
                        if len(known) >= MOST_SHORT:
                            known.clear()
                        known[t] = _cut(listed, t, folder)
                    cut = known[t]
                else:
                    cut = _cut(listed, t or "", folder)
                chunk.add(note, cut)
                if chunk.hits >= GROUP_HITS or chunk.size >= GROUP_CHARACTERS:
                    yield chunk.groups(listed, kinds, contexts)
                    chunk = _Chunk()
        if chunk.hits:
            yield chunk.groups(listed, kinds, contexts)

    return notes.select(F.col(id_col).cast("bigint").alias("note_id"), F.col(text).alias("text")).mapInArrow(scan, GROUP)


def mentions_of(groups: DataFrame) -> DataFrame:
    h = F.get("hits", 0)  # a filter on it may come before the one that leaves out empty lists
    eid = F.get(h["eids"], 0)
    return groups.filter("kind = 'mention'").select("note_id", "segment_no", "cluster_no", "text", eid.alias("eid"), h["surface_id"].alias("surface_id"), "source_start", "source_end", h["suspect"].alias("suspect"), F.coalesce(h["resolved_eid"] == eid, F.lit(False)).alias("resolved"))


def conflicts_of(groups: DataFrame) -> DataFrame:
    if "hash" in groups.columns:  # those of note_groups()
        return groups.filter("kind = 'conflict'").drop("kind")
    parts = [F.col("hits")[c] for c in ("surface", "surface_id", "eids")]
    ship(groups.sparkSession)
    return groups.filter("kind = 'conflict'").withColumn("hash", conflict_hash("left_context", "text", "right_context", *parts)).drop("kind")


def conflict_matches_of(conflicts: DataFrame) -> DataFrame:
    """One row a match of a conflict, with the columns that inherit_decisions() compares."""
    rows = conflicts.select("note_id", "segment_no", "cluster_no", "hash", F.explode("hits").alias("h"))
    return rows.select("note_id", "segment_no", "cluster_no", "hash", "h.surface", "h.surface_id", F.col("h.source_start").alias("start"), F.col("h.source_end").alias("end"), "h.eids", "h.resolved_eid")


def replacements(mentions: DataFrame, matches: DataFrame, folder: str = "wiki") -> DataFrame:
    """(note_id, wanted): the links that a note should have, effective mentions first, then decided conflicts."""
    head = ["note_id", "tier", "segment_no", "cluster_no", "start", "end", "text", "eid"]
    sure = mentions.filter(effective(F.col("suspect"), F.col("resolved"))).select("*", F.lit(0).alias("tier"), F.col("source_start").alias("start"), F.col("source_end").alias("end")).select(head)
    won = matches.filter(F.col("resolved_eid").isNotNull()).select("*", F.lit(1).alias("tier"), F.col("surface").alias("text"), F.col("resolved_eid").alias("eid")).select(head)
    target = F.concat(F.lit(f"{folder}/" if folder else ""), "eid").alias("target")
    rows = sure.unionByName(won).select("note_id", F.struct(*head[1:], target).alias("r"))
    return rows.groupBy("note_id").agg(F.array_sort(F.collect_list("r")).alias("wanted"))


def linked(groups: DataFrame, folder: str = "wiki") -> DataFrame:
    """replacements() of groups whose conflicts have no decisions but those of old links; the groups are read once."""
    h = F.get("hits", 0)
    eid = F.get(h["eids"], 0)
    sure = (F.col("kind") == "mention") & effective(h["suspect"], F.coalesce(h["resolved_eid"] == eid, F.lit(False)))
    target = lambda e: F.concat(F.lit(f"{folder}/" if folder else ""), e).alias("target")
    one = lambda tier, start, end, text, e: F.struct(F.lit(tier).alias("tier"), "segment_no", "cluster_no", start.alias("start"), end.alias("end"), text.alias("text"), e.alias("eid"), target(e))
    mention = F.array(one(0, F.col("source_start"), F.col("source_end"), F.col("text"), eid))
    won = F.transform(F.filter("hits", lambda m: m["resolved_eid"].isNotNull()), lambda m: one(1, m["source_start"], m["source_end"], m["surface"], m["resolved_eid"]))
    rows = groups.select("note_id", F.explode(F.when(sure, mention).when(F.col("kind") == "conflict", won)).alias("r"))
    return rows.groupBy("note_id").agg(F.array_sort(F.collect_list("r")).alias("wanted"))


def disjoint(wanted: Iterable[dict]) -> list[dict]:
    """Those that overlap none taken before, by source position."""
    starts: list[int] = []
    taken: list[dict] = []
    for w in wanted:
        k = bisect_right(starts, w["start"])
        if not (k and taken[k - 1]["end"] > w["start"]) and not (k < len(taken) and taken[k]["start"] < w["end"]):
            starts.insert(k, w["start"])
            taken.insert(k, w)
    return taken


def rewritten(text: str, wanted: list[dict], folder: str = "wiki") -> str:
    """The note with its wanted links: once per entity and section; old entity links give way to their text."""
    own = lambda w: (w["tier"], w["segment_no"], w["cluster_no"])
    ahead = disjoint(w for _, group in groupby(wanted, own) for w in disjoint(group))[::-1]
    out, linked, read = [], set(), 0

    def put(w: dict) -> int:
        bare = w["eid"] in linked or w["target"] is None
        out.append(w["text"] if bare else f"[[{w['target']}|{w['text']}]]")
        linked.add(w["eid"])
        return w["end"]

    for p in pieces(text, folder):
        if p.syntax == "text":
            at = max(p.start, read)
            while at < p.end:
                while ahead and ahead[-1]["start"] < at:
                    ahead.pop()
                if not ahead or ahead[-1]["start"] >= p.end:
                    out.append(text[at : p.end])
                    break
                out.append(text[at : ahead[-1]["start"]])
                at = read = put(ahead.pop())
        elif p.end > read:
            while ahead and ahead[-1]["start"] < p.start:
                ahead.pop()
            if p.syntax == "link" and p.text and ahead and ahead[-1]["start"] == p.start:
                read = put(ahead.pop())
                continue
            out.append(p.text)
            while ahead and ahead[-1]["start"] < p.end:
                ahead.pop()
            if p.syntax == "thematic_break":
                linked.clear()
    return "".join(out)


def render_notes(notes: DataFrame, wanted: DataFrame, id_col: str = "note_id", text: str = "text", folder: str = "wiki") -> DataFrame:
    """(note_id, text, changed) with the links of replacements(); a null note stays null."""
    ship(notes.sparkSession)

    @F.pandas_udf("string")
    def render(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else rewritten(t, [] if w is None else list(w), folder) for t, w in zip(texts, lists, strict=True)], dtype=object)

    joined = notes.select(F.col(id_col).alias("note_id"), F.col(text).alias("old")).join(wanted, "note_id", "left")
    return joined.withColumn("text", render("old", "wanted")).select("note_id", "text", (F.col("text") != F.col("old")).alias("changed"))
