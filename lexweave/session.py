"""Spark session helpers: one place for the settings that every job relies on."""

from __future__ import annotations

import hashlib
import os
import pickle
import zipfile
from functools import lru_cache
from pathlib import Path
from tempfile import mkdtemp

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def get_spark(master: str | None = None, partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter's session is used as it is."""
    builder = (
        SparkSession.builder.appName("lexweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEXWEAVE_DRIVER_MEMORY", "8g"))
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`, which may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """`rows`, whose Parquet is small beside the work that each of them makes, dealt over all cores."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def beside(rows: DataFrame, n: int, most: int = 50_000) -> DataFrame:
    """`rows`, of which there are `n`, as a side of a join: sent to all if they are few, else sorted and merged.

    The planner goes by the size of files, and Parquet holds millions of small rows in what it would send.
    """
    return F.broadcast(rows) if n <= most else rows.hint("merge")


def send_value(spark: SparkSession, value: object) -> str:
    """Send a bounded value to all executors as a file of the context; its name, for sent_value().

    For code that can't use broadcast variables, as stateful processors of streams can't.
    """
    body = pickle.dumps(value)
    name = f"lexweave-{hashlib.sha256(body).hexdigest()}"
    sc = spark.sparkContext
    if (sc.applicationId + name) not in _SHIPPED:
        _SHIPPED.add(sc.applicationId + name)
        path = Path(mkdtemp(prefix="lexweave-")) / name
        path.write_bytes(body)
        sc.addFile(str(path))
    return name


@lru_cache(maxsize=4)
def sent_value(name: str) -> object:
    return pickle.loads(Path(SparkFiles.get(name)).read_bytes())


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = Path(__file__).resolve().parent
    target = Path(mkdtemp(prefix="lexweave-")) / "lexweave_src.zip"
    with zipfile.ZipFile(target, "w") as out:
        for f in sorted(here.rglob("*.py")):
            out.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(target))
