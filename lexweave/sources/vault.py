"""Note files of a vault: texts with their observation (modification time, size, hash), and the plan of downloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.sources.dumps import check_date, dump_name, entity_dump_name

# Fixed value: where the public dumps are.
DUMPS_URL = "https://dumps.wikimedia.org"
SQL_COMPONENTS = ("page", "redirect", "page_props")
ENTITIES = "wikidata_entities"


def note_files(spark: SparkSession, root: str, entity_dir: str = "wiki", pattern: str = "*.md") -> DataFrame:
    """(path, text, mtime, size, hash) of every note below `root`, outside the folder of entity notes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    inner = F.regexp_replace("path", "^(?:file:)?/*", "/")
    start = F.length(F.lit("/" + root.removeprefix("file:").strip("/") + "/"))
    rows = files.select(F.substr(inner, start + 1).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), (F.unix_micros("modificationTime") / 1000).cast("bigint").alias("mtime"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))
    return rows.filter(~F.col("path").startswith(f"{entity_dir}/")) if entity_dir else rows


def download_plan(spark: SparkSession, wikis: list[str], components: list[str], date: str, out: str) -> DataFrame:
    """(component, wiki, url, path): a file a wiki and SQL component, and one file of entities for all."""
    check_date(date)
    if not all(w.strip() for w in wikis):
        raise ValueError("wiki names must not be empty")
    folder = "wikidatawiki/entities" if date == "latest" else f"wikidatawiki/entities/{date}"
    rows = []
    for component in components:
        if component == ENTITIES:
            rows.append((component, None, f"{DUMPS_URL}/{folder}/{entity_dump_name(date)}", f"{out}/wikidatawiki/{date}/{entity_dump_name(date)}"))
        elif component in SQL_COMPONENTS:
            rows += [(component, w, f"{DUMPS_URL}/{w}/{date}/{dump_name(w, date, component)}", f"{out}/{w}/{date}/{dump_name(w, date, component)}") for w in wikis]
        else:
            raise ValueError(f"unknown component: {component}")
    return spark.createDataFrame(rows, "component string, wiki string, url string, path string")
