"""Settings of a note vault, manifests of a published dictionary, and its fixed-width tables."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from lexweave.functions.markdown import trim

#: Record widths in bytes that a manifest must state; the last ones only where it has the tables they belong to.
WIDTHS = {"state_record_bytes": 16, "state_output_record_bytes": 12}
ENTITY_WIDTHS = {"surface_eid_index_record_bytes": 8}
COLOR_WIDTHS = {"eid_color_index_record_bytes": 8, "eid_color_value_record_bytes": 8}
LEGACY_WIDTHS = {"qid_index_record_bytes": 8}


@dataclass(frozen=True)
class Settings:
    runtime_dir: str = ""
    database_path: str = "notes.db"
    entity_dir: str = "wiki"
    preferred_lang: str = "zh"
    note_globs: tuple[str, ...] = ("**/*.md",)


def clean_path(value: str) -> str:
    return trim(value).replace("\\", "/").rstrip("/")


def settings(raw: dict[str, Any] | None) -> Settings:
    """Settings of stored JSON; anything of a wrong type or blank takes its default."""
    raw, kept = raw or {}, {}
    if isinstance(raw.get("runtimeDir"), str):
        kept["runtime_dir"] = clean_path(raw["runtimeDir"])
    for name, key in (("databasePath", "database_path"), ("entityDir", "entity_dir")):
        if isinstance(raw.get(name), str) and trim(raw[name]):
            kept[key] = clean_path(raw[name])
    if "entity_dir" in kept:
        kept["entity_dir"] = kept["entity_dir"].lstrip("/")
    if raw.get("preferredLang") in ("zh", "en"):
        kept["preferred_lang"] = raw["preferredLang"]
    globs = raw.get("noteGlobs")
    globs = re.split(r"\r?\n|,", globs) if isinstance(globs, str) else globs if isinstance(globs, list) else []
    if globs := tuple(t for g in globs if isinstance(g, str) and (t := trim(g))):
        kept["note_globs"] = globs
    return Settings(**kept)


def check_manifest(manifest: dict[str, Any], formats: set[str], entities: bool, colors: bool, legacy: bool) -> None:
    """Raise ValueError unless format, byte order, mode, widths and tables are ones that can be read."""
    for key, known in (("format", formats), ("endian", {"little"}), ("mode", {"charwise"})):
        if manifest.get(key) not in known:
            raise ValueError(f"unsupported {key}: {manifest.get(key)}")
    if not (entities or legacy):
        raise ValueError("the manifest has no candidate tables")
    widths = WIDTHS | (ENTITY_WIDTHS | (COLOR_WIDTHS if colors else {}) if entities else LEGACY_WIDTHS)
    for key, width in widths.items():
        if manifest.get(key) != width:
            raise ValueError(f"unsupported {key}: {manifest.get(key)}")


def little_endian(record: Column, at: int, size: int = 4) -> Column:
    """The unsigned number of `size` bytes at `at` (from 0) of a binary column."""
    pairs = [F.hex(F.substring(record, at + k + 1, 1)) for k in reversed(range(size))]
    return F.conv(F.concat(*pairs), 16, 10).cast("bigint")


def read_records(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """A table of little-endian u32 records, one bigint column a field; files are split between tasks."""
    rows = spark.sparkContext.binaryRecords(path, 4 * len(fields)).map(lambda b: (bytearray(b),))
    frame = spark.createDataFrame(rows, StructType().add("r", BinaryType()))
    return frame.select(*[little_endian(F.col("r"), 4 * k).alias(name) for k, name in enumerate(fields)])
