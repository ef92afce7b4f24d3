"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the text: at-signs, plus signs, digits, schemes and
identifier cues. From each anchor a local parser expands to the full span and validates it: mail addresses
(leftwards over the local part, then the domain), IPv4 addresses, card numbers (Luhn), phone numbers, and
beyond the base kinds account numbers after a cue (IBAN by its remainder mod 97), social security numbers
after a cue, and user data within URLs. Parsers never step back over a span of their own kind, which makes
spans leftmost and non-overlapping per kind, and time linear in the text.

Defined results: a null text counts as empty and has no spans. Repeated rows repeat their result. An empty
table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.spans import Span
from lexweave.llm.textmap import map_texts

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "url_user")
DIGITS = "0123456789"
# Cues in lower case; a match is verified by the parser that it leads to.
CUES = {"iban": "iban", "account": "iban", "konto": "iban", "cuenta": "iban", "compte": "iban", "ssn": "ssn", "social security": "ssn", "://": "url_user"}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
RUN = re.compile(r"[0-9]+")
ALNUM = re.compile(r"[A-Za-z0-9]")
#: How far a number may stand behind its cue: eight words on the cue's line, or signs and line ends.
NEAR = 120
SIGNS = re.compile(r"[^A-Za-z0-9]{0,20}")
WORDS = re.compile(r"(?:[^\S\n]*+\S++){0,8}+[^\S\n]*+")
NUMBER = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
IBAN = re.compile(rf"(?<![A-Za-z0-9]){NUMBER.pattern}")
SSN = re.compile(r"[^0-9\n]{0,120}?([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
URL_USER = re.compile(r"://([^\s/@:]++:[^\s/@]++)@")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
# Characters of an IBAN by country.
IBAN_SIZE = {w[:2]: int(w[2:]) for w in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20".split()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_ok(number: str) -> bool:
    plain = number.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def iban_after(text: str, at: int) -> tuple[int, int] | None:
    """The first account number within reach behind a cue that ends at `at`.

    A candidate ends where its country's numbers do; with an unknown country, at the last end at which it is valid.
    """
    reach = max(SIGNS.match(text, at).end(), WORDS.match(text, at, at + NEAR).end())
    after = at
    # a number may touch its cue, but no other word
    while (m := (after == at and NUMBER.match(text, at, at + NEAR + 64)) or IBAN.search(text, after, at + NEAR + 64)) and m.start() <= reach:
        start = m.start()
        after = start + 1
        # ends within the candidate at which no letter or digit follows
        ends = [e for e in range(m.end(), start + 14, -1) if text[e - 1] != " " and not ALNUM.match(text, e)]
        if size := IBAN_SIZE.get(text[start : start + 2]):
            ends = [e for e in ends if e - start - text.count(" ", start, e) == size] or ends[:1]
        for e in ends:
            if e - start - text.count(" ", start, e) >= 15 and iban_ok(text[start:e]):
                return start, e
    return None


@cache
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ("@", "+", *DIGITS, *CUES):
        found.add_word(word, word)
    found.make_automaton()
    return found


def find_spans(text: str) -> list[Span]:
    """All spans, by kind as listed, then start."""
    out: dict[str, list[Span]] = {k: [] for k in (*BASE_KINDS, *MORE_KINDS)}
    done = dict.fromkeys(out, 0)  # up to where each kind has read
    folded = text.lower()
    if len(folded) != len(text):  # a letter that is two in lower case would move what follows
        folded = text.translate(LOWER)
    for end, word in _anchors().iter(folded):
        at = end - len(word) + 1
        if word == "@":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := MAIL.match(text, start)):
                out["email"].append(("email", *m.span()))
                done["email"] = m.end()
        elif word == "+":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 8 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out["phone"].append(("phone", *m.span()))
        elif word in DIGITS:
            if at >= done["ip"]:
                if m := IP.match(text, at):
                    done["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
                        out["ip"].append(("ip", *m.span()))
                else:
                    done["ip"] = RUN.match(text, at).end()
            if at >= done["card"]:
                m = CARD.match(text, at)
                done["card"] = m.end() if m else at + 1
                if m and len(m[0]) >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(("card", *m.span()))
        elif at >= done[kind := CUES[word]]:
            if kind == "iban":
                span = iban_after(text, end + 1)
            else:
                m = SSN.match(text, end + 1) if kind == "ssn" else URL_USER.match(text, at)
                span = m and m.span(1)
            if span:
                out[kind].append((kind, *span))
                done[kind] = span[1]
    return [s for spans in out.values() for s in spans]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: doc_id, spans array<struct<kind, start, end>>."""

    def scan(texts: pd.Series) -> pd.DataFrame:
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t or "")] for t in texts]
        return pd.DataFrame({"spans": pd.Series(spans, dtype=object)})

    return map_texts(docs, id_col, text, scan, "spans array<struct<kind:string,start:long,end:long>>")


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts, base digest and all spans of find_pii() as text."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", one), ",").alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))
