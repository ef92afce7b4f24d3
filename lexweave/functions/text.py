"""Column functions on titles, identifiers and TSV fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, for trims that must not stop at plain blanks.
WHITE_SPACE = r"[\t-\r \u0085   -     　]"
U32_MAX = 4294967295


def surface_text(title: Column) -> Column:
    return F.replace(title, F.lit("_"), F.lit(" "))


def surface_key(title: Column) -> Column:
    return F.regexp_replace(surface_text(title), f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def qid_number(qid: Column) -> Column:
    """The number of Q<u32>; null for anything else."""
    number = F.expr("0") if qid is None else F.when(qid.rlike("^Q[0-9]+$"), F.substring(qid, 2, 20)).try_cast("bigint")
    return F.when(number <= U32_MAX, number)


def escape_tsv(value: Column) -> Column:
    for raw, coded in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        value = F.replace(value, F.lit(raw), F.lit(coded))
    return value


def unescape_tsv(value: Column) -> Column:
    """One pass: known escapes decode, an unknown one and a trailing backslash stay."""
    parts = F.regexp_extract_all(value, F.lit(r"(?s)\\.|[^\\]+|\\$"), F.lit(0))
    known = lambda p: F.when(p == "\\t", "\t").when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\\\", "\\").otherwise(p)
    return F.array_join(F.transform(parts, known), "")


def utf16_length(value: Column) -> Column:
    return (F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("bigint")


def entity_id_of_path(path: Column) -> Column:
    """The EID that names an entity note, from its file name; null without one."""
    found = F.regexp_extract(path, r"(?:^|/)(Q[1-9][0-9]*)\.md$", 1)
    return F.when(found != "", found)


def link_target(raw: Column) -> Column:
    """Cut at fragment, title or block mark; trim; forward slashes; no leading slash."""
    cut = F.trim(F.regexp_extract(raw, r'^([^#"^]*)', 1))
    return F.regexp_replace(F.replace(cut, F.lit("\\"), F.lit("/")), "^/+", "")


def split_csv(value: str) -> list[str]:
    """Items between commas, trimmed; empty ones drop out."""
    return [item for item in map(str.strip, value.split(",")) if item]
