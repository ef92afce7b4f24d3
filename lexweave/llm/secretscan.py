"""Secret scans by assignment-aware lexing.

A small lexer reads source and configuration syntax into name-literal pairs: name = literal, "name": literal,
name := literal, name: type = literal, name["key"] = literal, with + between parts or strings side by side; lists
and call arguments as values; arguments of calls that set a name; quotes with escapes, triple quotes and back
quotes; block scalars below a name; XML elements with CDATA, name and value attributes; command flags. Names
assigned anywhere in the same text are resolved, so a literal reaches every name it is passed on to; names
that stay unresolved are no literals. A bare word is one where it doesn't read as a name of code, or is the whole
value of a line of configuration (key: value, KEY=value). What a call that reads is asked for (its first string)
and what stands in subscripts are names, not literals. Each literal is scored by the
sensitive words in the names it reaches and by its own form. Base spans (assign, access, hex) are fixed
patterns over the same text.

A value keeps references to its terms and a summary of fixed size (length, the set of its characters, its ends),
never a joined text, so time and memory are linear in the text however often names are added up.

Defined results: a null text counts as empty and has no spans. Repeated rows repeat their result. An empty
table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.spans import Span
from lexweave.llm.textmap import map_texts

#: More than the longest placeholder.
EDGE = 16
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32}")

# Weights of words in target names.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pw": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "authorization": 0.8, "auth": 0.6, "key": 0.5, "private": 0.4, "access": 0.4, "api": 0.4, "signing": 0.4, "encryption": 0.4, "client": 0.1}
PLACEHOLDER = re.compile(r"example|changeme|placeholder|your[_-]?|xxxx|dummy|<|\$\{|\{\{|^(?:none|null|true|false|undefined)$", re.IGNORECASE)
# A type between a name and its "=": a word without digits or a short one, with type arguments and alternatives.
_ONE_TYPE = r"(?:&[\x20\t]*+(?:'[a-z]++[\x20\t]++)?)?(?:[A-Za-z_.]++(?:::[A-Za-z_]++)*+|[A-Za-z0-9_.]{1,7}+)(?![A-Za-z0-9_.])(?:<[^<>\n=:]*+>|\[(?:[^\[\]\n=:]++|\[[^\[\]\n=:]*+\])*+\])*+[?!]?"
TYPE = rf"(?::[\x20\t]*+{_ONE_TYPE}(?:[\x20\t]*+\|[\x20\t]*+{_ONE_TYPE})*+|[\x20\t]string)(?:[\x20\t]++(?==(?!=))|(?==[\x20\t]*+[\"'`]))"
KEYS = r"(?:\[[\x20\t]*+(?:\"[^\"\n\]]*+\"|'[^'\n\]]*+')[\x20\t]*+\])*+"
TARGET = re.compile(rf"(?<![A-Za-z0-9_.\-])([\"'`]?)([A-Za-z_][A-Za-z0-9_.\-]*+)\1({KEYS})(?:{TYPE})?([\x20\t]*+)(:=|=>|=(?!=)|:(?!:))([\x20\t]*+)")
LAST_KEY = re.compile(r"[\"']([^\"'\n\]]*)[\"'][\x20\t]*\]$")
TERM = re.compile(r"\"\"\"((?s:.*?))\"\"\"|'''((?s:.*?))'''|`([^`]*)`|\"((?:[^\"\\\n]|\\[^\n])*+)\"|'((?:[^'\\\n]|\\[^\n])*+)'|\"([^\"\n]*)\"|'([^'\n]*)'|([A-Za-z_][A-Za-z0-9_.\-]*+)(?![A-Za-z0-9+/=])|([A-Za-z0-9+/_.=\-]+)")
_BREAKS = r"[\x20\t]*+(?:\\?\r?\n[\x20\t]*+)*+"
PLUS = re.compile(rf"{_BREAKS}\+{_BREAKS}")
NAME_TERM = 8  # the group of TERM that may be a name
# A block scalar's mark after a name; its lines are indented deeper than the name's.
BLOCK = re.compile(r"[|>][+-]?[0-9]?[\x20\t]*+\r?\n")
INDENT = re.compile(r"[\x20\t]*+")
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:\-]*+)>[\x20\t\r\n]*+(?:<!\[CDATA\[((?:[^\]<]|\](?!\]>)|<(?!!\[CDATA\[))*+)\]\]>[\x20\t\r\n]*+|([^<>]+))</\1>")
ATTRIBUTES = re.compile(r"(?:name|key|id)[\x20\t]*+=[\x20\t]*+([\"'])([A-Za-z_][A-Za-z0-9_.:\-]*+)\1\s++value[\x20\t]*+=[\x20\t]*+([\"'])([^\"'\n]*+)\3")
FLAG = re.compile(r"(?<![A-Za-z0-9_\-])--?([A-Za-z][A-Za-z0-9_\-]*+)(?:=|[\x20\t]++)(?:\"([^\"\n]*+)\"|'([^'\n]*+)'|(?![\-\"'])([^\s\"']++))")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def base_spans(text: str) -> list[Span]:
    """Assign, access and hex spans, by start, then kind."""
    found: list[tuple[int, int, Span]] = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, ("assign", *m.span())) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, ("access", *m.span())) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if LONG_HEX.search(text):
        found += [(m.start(), 2, ("hex", *m.span())) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return [s for _, _, s in sorted(found)]


@dataclass
class Value:
    """A literal or a sum of earlier values; what its score needs is summed up, its text is not kept."""

    terms: list[Value]
    span: tuple[int, int] | None = None
    length: int = 0
    kinds: int = 0  # a bit a character; beyond ASCII, 128 bits stand for all others
    placeholder: bool = False
    head: str = ""
    tail: str = ""
    best: float = 0.0

    @classmethod
    def literal(cls, text: str, a: int, b: int) -> Value:
        s = text[a:b]
        kinds = 0
        for c in set(s):
            kinds |= 1 << (ord(c) if ord(c) < 128 else 128 + ord(c) % 128)
        return cls([], (a, b), min(len(s), LONG_ENOUGH), kinds, bool(PLACEHOLDER.search(s)), s[:EDGE], s[-EDGE:])

    @classmethod
    def joined(cls, terms: list[Value]) -> Value:
        out = cls(terms)
        for t in terms:
            # a placeholder may lie across the seam
            out.placeholder = out.placeholder or t.placeholder or (bool(out.tail) and bool(PLACEHOLDER.search(f"\n{out.tail}{t.head}\n")))
            out.length = min(out.length + t.length, LONG_ENOUGH)
            out.kinds |= t.kinds
            out.head = (out.head + t.head)[:EDGE]
            out.tail = (out.tail + t.tail)[-EDGE:]
        return out

    def score(self) -> float:
        """0 to 1 by length, number of different characters and their classes; placeholders score 0."""
        if self.length < 8 or self.placeholder:
            return 0.0
        spread = math.log2(self.kinds.bit_count()) / math.log2(min(self.length, 64))
        classes = sum(bool(self.kinds & c) for c in CLASSES)
        return max(0.0, min(1.0, spread * (0.4 + 0.3 * classes)))


def _bits(characters: str) -> int:
    return sum(1 << ord(c) for c in characters)


#: Beyond this length a value's score no longer changes.
LONG_ENOUGH = 64
_LOWER, _UPPER, _DIGITS = _bits("abcdefghijklmnopqrstuvwxyz"), _bits("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bits("0123456789")
CLASSES = (_LOWER, _UPPER, _DIGITS, ~(_LOWER | _UPPER | _DIGITS))


def block_scalar(text: str, name_at: int, at: int) -> tuple[int, int]:
    """Start and end of the indented lines from `at` on, below the line of `name_at`; equal if there are none."""
    depth = INDENT.match(text, text.rfind("\n", 0, name_at) + 1)
    least = len(depth[0]) + 1
    start = end = at
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        first = INDENT.match(text, at, stop).end()
        if first < stop and text[first:stop] != "\r":
            if first - at < least:
                break
            start, end = first if start == end else start, stop
        at = stop + 1
    return start, end


def _is_code(word: str) -> bool:
    """Whether a bare word reads as a name in a program: words of some length, not changing kind at every character."""
    parts = PART.findall(word)
    return len(word) >= 3 * len(parts)


def _whole_line(text: str, m: re.Match, end: int) -> bool:
    """Whether a target and its bare value are a line of configuration: key: value, or KEY=value without blanks."""
    if m[5] not in (":", "=") or (m[5] == "=" and (m[4] or m[6])):
        return False
    return LINE_START.fullmatch(text, text.rfind("\n", 0, m.start()) + 1, m.start()) is not None and LINE_END.match(text, end) is not None


LINE_START = re.compile(r"[\x20\t+]*+(?:-[\x20\t]++)?(?:export[\x20\t]++)?")
LINE_END = re.compile(r"[\x20\t]*+(?:#[^\n]*+)?\r?(?=\n|\Z)")
PREFIX = re.compile(r"[bBrRfFuU]{1,2}(?=[\"'])")
HEAD = re.compile(r"([A-Za-z_][A-Za-z0-9_.]*+)?([(\[{])\s*+")
SUBSCRIPT = re.compile(r"(?:\[[^\[\]\n]*+\])++")
GAP, SIDE = re.compile(r"\s*+"), re.compile(r"[\x20\t]*+(?=[\"'])")
READS = {"get", "getenv", "env", "environ", "read", "load", "fetch", "find", "lookup", "has", "is", "check", "require", "config", "param", "input", "ask", "prompt"}
CALL = re.compile(r"(?<![A-Za-z0-9_.\-])([A-Za-z_][A-Za-z0-9_.]*+)\(\s*+(?=[\"'`bBrRfFuU])")


def _reads(name: str) -> bool:
    words = [w.lower() for w in PART.findall(name.rpartition(".")[2])]
    return bool(words) and words[0] in READS


def _bracketed(text: str, at: int, known: dict[str, Value]) -> tuple[list[list[Value]], int]:
    """The elements within brackets and calls that open at `at`, each as its terms; and where reading ended.

    An assignment inside (a named argument, an entry of a table) ends it, as that is read on its own.
    """
    elements: list[list[Value]] = [[]]
    skip: list[bool] = []  # by open bracket: whether its first string is a name to be looked up
    while at < len(text):
        if text[at] in ")]}":
            skip.pop()
            elements.append([])
            at += 1
            if not skip:
                return elements, at
        elif text[at] == ",":
            elements.append([])
            skip[-1] = False
            at += 1
        elif head := HEAD.match(text, at):
            if head[1] and head[2] == "[":  # a subscript: its key is no literal
                inner = SUBSCRIPT.match(text, head.start(2))
                if not inner:
                    return elements, head.end()
                at = inner.end()
            else:
                skip.append(bool(head[1]) and head[2] == "(" and _reads(head[1]))
                at = head.end()
        elif skip and TARGET.match(text, at):
            return elements, at
        else:
            prefix = PREFIX.match(text, at)
            t = TERM.match(text, prefix.end() if prefix else at)
            if not t or t.end() == at:
                return elements, at
            group = t.lastindex or 1
            if group >= NAME_TERM:
                if t[group] in known:
                    elements[-1].append(known[t[group]])
            elif not skip[-1]:
                elements[-1].append(Value.literal(text, *t.span(group)))
            at = t.end()
        at = GAP.match(text, at).end()
        if text.startswith("+", at):
            at = GAP.match(text, at + 1).end()
    return elements, at


def assignments(text: str) -> Iterator[tuple[str, Value]]:
    """(name, value) by place: constants propagate from names assigned earlier, at last from those assigned later."""
    known: dict[str, Value] = {}
    later: dict[str, str] = {}  # names assigned from a name that isn't known yet
    waiting: list[tuple[str, str]] = []
    at = blocked = read = 0
    while m := TARGET.search(text, at):
        at = m.end()
        name = LAST_KEY.search(m[3])[1] if m[3] else m[2]
        # the lines of a block may hold assignments of their own, but no further block
        if m.start() >= blocked and (mark := BLOCK.match(text, at)):
            a, blocked = block_scalar(text, m.start(), mark.end())
            if a < (b := blocked):
                known[m[2]] = Value.joined([Value.literal(text, a, b)])
                yield name, known[m[2]]
                continue
        # what has been read as an element of brackets is not opened again
        if at >= read and (head := HEAD.match(text, at)) and not (head[1] and head[2] != "("):
            elements, read = _bracketed(text, at, known)
            values = [Value.joined(e) for e in elements if e]
            for value in values:
                yield name, value
            if values and not m[3]:
                known[m[2]] = values[0] if len(values) == 1 else Value.joined(values)
            continue
        terms: list[Value] = []
        while t := TERM.match(text, (prefix := PREFIX.match(text, at)) and prefix.end() or at):
            group, at = t.lastindex or 1, t.end()
            if group == NAME_TERM and t[group] in known:
                terms.append(known[t[group]])
            elif group == NAME_TERM and not _whole_line(text, m, at) and (text.startswith(("(", "["), at) or _is_code(t[group])):
                if not terms:
                    later[m[2]] = t[group]
                    waiting.append((name, t[group]))
            else:
                terms.append(Value.literal(text, *t.span(group)))
            if group < NAME_TERM and (side := SIDE.match(text, at)) and side.end() < len(text):
                at = side.end()
                continue
            plus = PLUS.match(text, at)
            # a plus sign at a line's start may also mark an added line with an assignment of its own
            if not plus or ("\n" in plus[0] and TARGET.match(text, plus.end())):
                break
            at = plus.end()
        if terms:
            if not m[3]:
                known[m[2]] = Value.joined(terms)
            yield name, known[m[2]] if not m[3] else Value.joined(terms)
    for name, other in waiting:
        passed = {name}
        while other not in known and other in later and other not in passed:
            passed.add(other)
            other = later[other]
        if other in known:
            yield name, Value.joined([known[other]])


def called(text: str) -> Iterator[tuple[str, Value]]:
    """(name, literal) of strings that are passed by place to a call whose own name says what they are."""
    for m in CALL.finditer(text):
        name = m[1].rpartition(".")[2]
        if _reads(name) or name_score(name) < 0.5:
            continue
        at = m.end()
        while t := TERM.match(text, (prefix := PREFIX.match(text, at)) and prefix.end() or at):
            if (group := t.lastindex or 1) < NAME_TERM:
                yield name, Value.joined([Value.literal(text, *t.span(group))])
            at = GAP.match(text, t.end()).end()
            if not text.startswith(",", at):
                break
            at = GAP.match(text, at + 1).end()


def marked_up(text: str) -> Iterator[tuple[str, Value]]:
    """(name, literal) of XML elements, of name and value attributes, and of command flags."""
    if "</" in text:
        yield from ((m[1], Value.joined([Value.literal(text, *m.span(m.lastindex))])) for m in ELEMENT.finditer(text))
    if "value" in text:
        yield from ((m[2], Value.joined([Value.literal(text, *m.span(4))])) for m in ATTRIBUTES.finditer(text))
    if "-" in text:
        yield from ((m[1], Value.joined([Value.literal(text, *m.span(m.lastindex))])) for m in FLAG.finditer(text) if m.lastindex > 1)


def name_score(name: str) -> float:
    parts = [p.lower() for p in PART.findall(name)]
    return min(1.0, sum(SENSITIVE.get(p, SENSITIVE.get(p.removesuffix("s"), 0.0)) for p in parts))


def literal_score(value: str) -> float:
    """0 to 1 by length, spread of characters and classes; placeholders score 0."""
    return Value.literal(value, 0, len(value)).score()


def literal_spans(text: str, threshold: float = 0.5) -> list[tuple[int, int, float]]:
    """Literals that reach a sensitive name: (start, end, best score), by start."""
    values = []
    for found in (assignments(text) if "=" in text or ":" in text else (), called(text) if "(" in text else (), marked_up(text)):
        for name, value in found:
            values.append(value)
            weight = name_score(name)
            if weight >= threshold and (score := weight * value.score()) >= threshold:
                value.best = max(value.best, score)
    best: dict[tuple[int, int], float] = {}
    for value in reversed(values):  # terms are older than their sums
        if value.best:
            for term in value.terms:
                term.best = max(term.best, value.best)
                if term.span:
                    best[term.span] = max(best.get(term.span, 0.0), term.best)
    return [(a, b, s) for (a, b), s in sorted(best.items()) if b > a]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row a document: doc_id, spans array<struct<kind, start, end, score>>; base spans score 1."""

    def scan(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            t = t or ""
            spans = [{"kind": k, "start": a, "end": b, "score": 1.0} for k, a, b in base_spans(t)]
            out.append(spans + [{"kind": "literal", "start": a, "end": b, "score": s} for a, b, s in literal_spans(t, threshold)])
        return pd.DataFrame({"spans": pd.Series(out, dtype=object)})

    return map_texts(docs, id_col, text, scan, "spans array<struct<kind:string,start:long,end:long,score:double>>")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts, base digest and all spans of find_secrets() as text."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    rank = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(_rank(a["kind"]) - _rank(b["kind"])))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(rank, one), ",").alias("spans"),
        count("literal").alias("n_literal"),
    )


def _rank(kind):
    return F.when(kind == "assign", 0).when(kind == "access", 1).when(kind == "hex", 2).otherwise(3)
