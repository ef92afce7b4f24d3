"""Pieces of a Markdown note: runs of text, expanded entity links, and syntax that matches must not cross.

Runs stand for their characters: character k of a run has source position start + k, while every character of
an expanded link has the whole link as its source. Positions are code points. Searches ahead remember what they
found, so time stays linear however many openers a text leaves unclosed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

#: White space as ECMAScript has it, for use in character classes; without the line feed in INLINE_SPACE.
INLINE_SPACE = r"\t\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = r"\n" + INLINE_SPACE
_EDGES = re.compile(f"^[{SPACE}]+|[{SPACE}]+$")
_END = r"(?:\n|\Z)"
_PIPED = rf"(?:[^\\|\n]|\\[^\n]|\\(?=\n|\Z))*+\|[^\n]*+{_END}"
_DASHES = rf":?-{{3,}}+:?[{INLINE_SPACE}]*+"
# Rules that hold at the start of a line, in order of precedence.
BLOCKS = [
    ("blockquote", re.compile(rf"(?: {{0,3}}>[^\n]*+{_END})++")),
    ("markdown_table", re.compile(rf"(?=[^\n]*\n[{INLINE_SPACE}]*+[|:-]){_PIPED}[{INLINE_SPACE}]*+(?:\|[{INLINE_SPACE}]*+)?{_DASHES}(?:\|[{INLINE_SPACE}]*+{_DASHES})+\|?[{INLINE_SPACE}]*+{_END}(?:{_PIPED})*+")),
    ("thematic_break", re.compile(rf" {{0,3}}([*_-])(?:[ \t]*+\1){{2,}}+[ \t]*+{_END}")),
    ("fenced_code", re.compile(rf"(`{{3}}|~{{3}})(?:[^\n]*+\n(?s:.*?)\n\1[^\n]*+{_END}|(?s:.*))")),
]
FRONTMATTER = re.compile(r"---\n(?s:.*?)\n---\n?")
FOOTNOTE_DEF = re.compile(r" {0,3}\[\^[^\]\r\n]++\]:[ \t]*+")
TAG_NAME = re.compile(r"<([A-Za-z][A-Za-z0-9-]*+)")
TAG = re.compile(rf"(?:(?<=[{SPACE}(\[{{:;,，。；：！？])|\A)#([^{SPACE}#\[\]{{}}()<>.,;:!?，。；：！？]++)")
EMPHASIS = re.compile(r"\*{1,3}|_{1,3}")
TICKS = re.compile("`+")
SPECIAL_START = re.compile(r"[\n<!\[`*_#]")


class Piece(NamedTuple):
    syntax: str  # "text", "link" (expanded), or the name of a syntax
    text: str
    start: int
    end: int
    eid: str | None = None
    path: str | None = None


def trim(text: str) -> str:
    return _EDGES.sub("", text)


def entity_path(target: str, folder: str) -> str | None:
    """The path of the entity note that a link leads to, if it leads into `folder`."""
    plain = trim(re.split(r'[#"^]', target, maxsplit=1)[0]).replace("\\", "/").lstrip("/")
    prefix = f"{folder}/" if folder else ""
    if not plain.startswith(prefix) or plain == prefix:
        return None
    return plain if plain.endswith(".md") else f"{plain}.md"


def percent_decoded(target: str) -> str:
    """Decoded as UTF-8; as it is where that fails."""
    if re.search("%(?![0-9A-Fa-f]{2})", target):
        return target
    try:
        return unquote_to_bytes(target).decode()
    except UnicodeDecodeError:
        return target


def shown_name(target: str) -> str:
    page = target.split("#", 1)[0]
    name = next((s for s in reversed(page.split("/")) if s), page)
    return re.sub(r"\.md\Z", "", name, flags=re.IGNORECASE)


class _Ahead:
    """Next places of literals, patterns, closing brackets and backtick runs; places asked for only ever grow."""

    def __init__(self, text: str):
        self.text, self.known = text, {}
        self.runs = None
        self.pairs = None

    def find(self, what: str | re.Pattern, at: int) -> int:
        """-1 if there is none at or after `at`."""
        asked, last = self.known.get(what, (0, -2))
        if last == -2 or asked > at or (last != -1 and last < at):
            if isinstance(what, str):
                last = self.text.find(what, at)
            else:
                last = m.start() if (m := what.search(self.text, at)) else -1
            self.known[what] = (at, last)
        return last

    def closer(self, at: int) -> int | None:
        """Where the bracket at `at` closes, by depth of its own kind; backslashes escape."""
        if self.pairs is None:
            self.pairs = _pairs(self.text, "[", "]") | _pairs(self.text, "(", ")")
        return self.pairs.get(at)

    def ticks(self, n: int, at: int) -> int:
        """The next run of `n` backticks or more."""
        if self.runs is None:
            runs = [m.span() for m in TICKS.finditer(self.text)]
            self.runs, longest = [], 0
            for a, b in reversed(runs):
                longest = max(longest, b - a)
                self.runs.append((a, b - a, longest))
        while self.runs and self.runs[-1][0] < at:
            self.runs.pop()
        if not self.runs or self.runs[-1][2] < n:
            return -1
        return next(a for a, size, _ in reversed(self.runs) if size >= n)


def _pairs(text: str, opener: str, closer: str) -> dict[int, int]:
    """Opening to closing place. An escaped opener, should one be asked for, shares its level's closer."""
    found: dict[int, int] = {}
    levels: list[list[int]] = [[]]
    for m in re.finditer(rf"\\(?s:.)?|\{opener}|\{closer}", text):
        at, what = m.start(), m[0]
        if what == opener:
            levels.append([at])
        elif what == closer:
            found |= dict.fromkeys(levels.pop(), at)
            levels = levels or [[]]
        elif what == f"\\{opener}":
            levels[-1].append(at + 1)
    return found


def _html_end(text: str, at: int, ahead: _Ahead) -> int | None:
    name = TAG_NAME.match(text, at)
    if not name:
        return None
    if text.startswith(">", name.end()):
        end = name.end() + 1
    elif re.match(f"[{SPACE}]", text[name.end() : name.end() + 1]) and (close := ahead.find(">", name.end())) >= 0:
        end = close + 1
    else:
        return None
    needle = f"</{name[1].lower()}>"
    close = ahead.find(re.compile(re.escape(needle), re.IGNORECASE | re.ASCII), end)
    return end if close < 0 else close + len(needle)


def _bracketed(text: str, at: int, ahead: _Ahead, folder: str) -> Piece | None:
    """A wikilink, a Markdown link or image at `at`."""
    bang = text.startswith("!", at)
    first = at + bang
    if text.startswith("[[", first) and (close := ahead.find("]]", first + 2)) >= 0:
        target, bar, alias = text[first + 2 : close].partition("|")
        target, end, kind = trim(target), close + 2, "wikilink"
        label = alias if bar else shown_name(target)
    elif text.startswith("[", first) and (middle := ahead.closer(first)) and text.startswith("(", middle + 1) and (close := ahead.closer(middle + 1)):
        target = percent_decoded(trim(text[middle + 2 : close]).split(" ", 1)[0])
        label, end, kind = text[first + 1 : middle], close + 1, "markdown_image" if bang else "markdown_link"
    else:
        return None
    path = None if bang else entity_path(target, folder)
    if path is None:
        return Piece(kind, text[at:end], at, end)
    eid = re.fullmatch(r"(?:.*/)?(Q[1-9][0-9]*)\.md", path, re.DOTALL)
    return Piece("link", label, at, end, eid[1] if eid else None, path)


def _special(text: str, at: int, ahead: _Ahead, folder: str) -> Piece | None:
    """What other than plain text begins at `at`."""
    make = lambda syntax, end: Piece(syntax, text[at:end], at, end)
    fresh_line = at == 0 or text[at - 1] == "\n"
    if fresh_line:
        for syntax, rule in BLOCKS:
            if m := rule.match(text, at):
                before = text[text.rfind("\n", 0, max(at - 1, 0)) + 1 : max(at - 1, 0)]
                if syntax != "thematic_break" or not trim(before):
                    return make(syntax, m.end())
    c = text[at]
    if c == "<":
        if text.startswith("<!--", at):
            close = ahead.find("-->", at + 4)
            return make("html_comment", len(text) if close < 0 else close + 3)
        end = _html_end(text, at, ahead)
        return make("html", end) if end else None
    if c in "[!" and (found := _bracketed(text, at, ahead, folder)):
        return found
    if fresh_line and (m := FOOTNOTE_DEF.match(text, at)):
        return make("footnote_def", m.end())
    if c == "[" and text.startswith("[^", at):
        stop = ahead.find(_FOOTNOTE_STOP, at + 2)
        return make("footnote_ref", stop + 1) if stop > at + 2 and text[stop] == "]" else None
    if c == "`":
        n = TICKS.match(text, at).end() - at
        close = ahead.ticks(n, at + n)
        return make("inline_code", close + n) if close >= 0 else None
    if c in "*_":
        return make("markdown_emphasis", EMPHASIS.match(text, at).end())
    if c == "#" and (m := TAG.match(text, at)) and re.search("[^0-9/]", m[1]):
        return make("obsidian_tag", m.end())
    return None


_FOOTNOTE_STOP = re.compile(r"[\]\r\n]")


def pieces(text: str, folder: str = "wiki") -> Iterator[Piece]:
    """The pieces of a note in order; `folder` holds the entity notes."""
    ahead, at, plain = _Ahead(text), 0, 0
    if m := FRONTMATTER.match(text):
        yield Piece("frontmatter", m[0], 0, m.end())
        at = plain = m.end()
    while at < len(text):
        if found := _special(text, at, ahead, folder):
            if plain < at:
                yield Piece("text", text[plain:at], plain, at)
            yield found
            at = plain = found.end
        else:
            # a line feed is plain itself; what follows it is at the start of a line
            jump = SPECIAL_START.search(text, at + (text[at] != "\n"))
            at = len(text) if not jump else jump.end() if jump[0] == "\n" else max(jump.start(), at + 1)
    if plain < at:
        yield Piece("text", text[plain:at], plain, at)
