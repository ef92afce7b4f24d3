"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a file of ranks (base64 token, rank). The driver turns it once into a tokenizers model:
bytes map to printable characters, and each token's merge is the last step of merging its bytes by lower
ranks. The model's text form (fixed by the vocabulary, a few MB) is broadcast and loaded once a worker.
Special tokens do not exist. Ids and offsets come from the library's batch encoding. As every match of the
split pattern is encoded by itself, a worker asks the library once for each different match, numbers the matches,
keeps their ids and offsets in flat arrays (beyond `MEMO` matches or `MEMO_CHARS` characters it starts anew),
gathers a text's from there and shifts the offsets to where each match stands. Matches are found by `regex` in texts of characters on whose classes it agrees with
the library (`PLAIN`); any other text goes to the library whole. Long texts are cut where a match must end, so
that a worker holds a bounded number of matches, unless a single match is longer. Decoding looks up each
id's characters and reverses the byte table; a character split over tokens comes out whole, as bytes are
joined before they are read as UTF-8.

Defined results: a null text counts as empty and has no tokens. Repeated rows repeat their result. An empty
table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.textmap import map_texts

CHARS_AT_ONCE, AT_ONCE = 1 << 19, 4_096
MEMO, MEMO_CHARS = 250_000, 4_000_000
#: Blocks of Unicode whose letters, numbers and blanks all versions of the classes agree on.
PLAIN = re.compile("[\x00-\u02af\u0391-\u03a1\u03a3-\u03c9\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20a0-\u20ac\u2190-\u22ff\u3001-\u3003\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01\uff0c\uff1a\uff1b\uff1f\U0001f300-\U0001f320\U0001f400-\U0001f4fc\U0001f600-\U0001f640]*+")
MATCH_END = re.compile(r"[!-~](?=[ \n])")


@cache
def byte_characters() -> tuple[str, ...]:
    """The character of each byte: itself if printable and no blank, else one from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return tuple(chr(b) if b in plain else chr(next(spare)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that make `token` when its bytes merge by ranks below its own; None if they don't."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], limit))
        if ranks.get(parts[best] + parts[best + 1], limit) >= limit:
            return None
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@cache
def tokenizer_json(path: str, pattern: str) -> str:
    """The tokenizers model of a rank file, as text."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    spell = lambda token: "".join(chars[b] for b in token)
    merges = [(spell(m[0]), spell(m[1])) for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (m := _last_merge(t, ranks))]
    model = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
    return model.to_str()


def cut(text: str) -> Iterator[str]:
    """The text in pieces of bounded length where it allows: between a visible ASCII character and a blank or line feed."""
    at = 0
    while len(text) - at > CHARS_AT_ONCE and (m := MATCH_END.search(text, at + CHARS_AT_ONCE // 2)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


class Matches(dict):
    """Numbers matches as they come, and holds the ids and offsets of each."""

    def __init__(self) -> None:
        self.ids, self.offsets = array("I"), array("i")
        #: by number: the match's length, its tokens, and where they begin
        self.lengths, self.counts, self.begins = array("q"), array("q"), array("q")
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, match: str) -> int:
        self[match] = number = len(self)
        self.new.append(match)
        return number

    def learn(self, coded: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Takes the counts, ids and offsets of the new matches, in any number of slices."""
        self.chars += sum(map(len, self.new))
        self.lengths.extend(map(len, self.new))
        for counts, ids, offsets in coded:
            self.begins.frombytes((len(self.ids) + np.cumsum(counts) - counts).tobytes())
            self.counts.frombytes(counts.tobytes())
            self.ids.frombytes(ids.tobytes())
            self.offsets.frombytes(offsets.tobytes())
        self.new = []


def gather(matches: Matches, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of matches that follow each other, and the start and end of each from the first match on."""
    lengths, counts, begins = (np.frombuffer(a, np.int64)[numbers] for a in (matches.lengths, matches.counts, matches.begins))
    before = np.cumsum(counts) - counts
    at = np.repeat(begins - before, counts) + np.arange(counts.sum())
    starts = (np.cumsum(lengths) - lengths).astype(np.int32)
    return np.frombuffer(matches.ids, "<u4")[at], np.frombuffer(matches.offsets, "<i4").reshape(-1, 2)[at] + np.repeat(starts, counts)[:, None]


def _numbers(encoding) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array(encoding.ids, np.uint32)
    return ids, np.fromiter(chain.from_iterable(encoding.offsets), np.int32, 2 * len(ids)).reshape(-1, 2)


class Codec:
    """Encodes and decodes in one process."""

    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.by_match = Tokenizer(self.tokenizer.model)  # both read one model, which a worker holds once
        split, bytelevel = self.tokenizer.pre_tokenizer
        self.by_match.pre_tokenizer = bytelevel
        self.matches = regex.compile(json.loads(model)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.memo = Matches()
        back = {c: b for b, c in enumerate(byte_characters())}
        vocab = self.tokenizer.get_vocab()
        self.bytes_of = [b""] * (max(vocab.values(), default=-1) + 1)
        for word, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in word)

    def _batch(self, matches: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The number of tokens a match, the ids, and the offsets within the matches, in slices of `AT_ONCE` matches."""
        slices = [matches[at : at + AT_ONCE] for at in range(0, len(matches), AT_ONCE)]
        for words, e in zip(slices, self.by_match.encode_batch(slices, is_pretokenized=True, add_special_tokens=False), strict=True):
            yield np.bincount(np.array(e.word_ids, np.int64), minlength=len(words)), *_numbers(e)

    def _piece(self, piece: str) -> tuple[np.ndarray, np.ndarray]:
        if not PLAIN.fullmatch(piece):
            return _numbers(self.tokenizer.encode(piece, add_special_tokens=False))
        if len(self.memo) > MEMO or self.memo.chars > MEMO_CHARS:
            self.memo = Matches()
        memo = self.memo
        found = self.matches(piece)
        numbers = np.fromiter(map(memo.__getitem__, found), np.int64, len(found))
        memo.learn(self._batch(memo.new))
        return gather(memo, numbers)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the start and end of each in code points."""
        ids, offsets, at = [], [], 0
        for piece in cut(text):
            some, places = self._piece(piece)
            ids.append(some)
            offsets.append(places + np.int32(at))
            at += len(piece)
        return (ids[0], offsets[0]) if len(ids) == 1 else (np.concatenate(ids), np.concatenate(offsets))

    def decode_bytes(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: Sequence[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@cache
def codec(model: str) -> Codec:
    return Codec(model)


def _model(spark: SparkSession, path: str | None, pattern: str | None):
    return spark.sparkContext.broadcast(tokenizer_json(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN))


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, and starts and ends array<int> in code points."""
    model = _model(docs.sparkSession, path, pattern)

    def run(batch: pd.Series) -> pd.DataFrame:
        rows = [codec(model.value).encode(t or "") for t in batch]
        columns = {"ids": [i.view(np.int32) for i, _ in rows], "starts": [o[:, 0] for _, o in rows], "ends": [o[:, 1] for _, o in rows]}
        return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in columns.items()})

    return map_texts(docs, id_col, text, run, "ids array<int>, starts array<int>, ends array<int>")


def decode(tokens: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and text of `tokens` (doc_id, ids); null ids give an empty text."""
    model = _model(tokens.sparkSession, path, pattern)

    def run(batch: pd.Series) -> pd.DataFrame:
        c = codec(model.value)
        return pd.DataFrame({"text": [c.decode(i if i is not None else ()) for i in batch]})

    return map_texts(tokens, "doc_id", ids, run, "text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_split (tokens that begin within a character) a document, and the ids if asked for."""
    model = _model(docs.sparkSession, path, pattern)

    def run(batch: pd.Series) -> pd.DataFrame:
        c, sha, rows = codec(model.value), hashlib.sha256, []
        for t in batch:
            ids, offsets = c.encode(t or "")
            split = int((offsets[1:, 0] < offsets[:-1, 1]).sum())
            row = (len(ids), sha(ids.tobytes()).hexdigest(), sha(c.decode_bytes(ids.tolist())).hexdigest(), split)
            rows.append((*row, ids.view(np.int32)) if with_ids else row)
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "n_split", *["ids"] * with_ids])

    return map_texts(docs, id_col, text, run, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long" + ", ids array<int>" * with_ids)
