"""Intermediate tables in the folder that all executors share.

`spark.checkpoint.dir` (or the context's checkpoint folder) names that folder. A staged table cuts lineage,
survives the loss of any executor, and gives the planner true sizes for its join choice. Staged tables live
until the process ends, or until the released() block in which they were made is left.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator
from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: list[str] = []
_STAGED: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local session without one (a test) gets a folder of its own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_ROOT:
        _OWN_ROOT.append("file://" + mkdtemp(prefix="lexweave-shared-"))
    return _OWN_ROOT[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted like a staged table."""
    path = f"{shared_root(spark)}/lexweave/{uuid.uuid4().hex}-{name}"
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_staged(kept: int = 0) -> None:
    """Delete every staged table of this process but the first `kept`; results that still read them must be written first."""
    while len(_STAGED) > kept:
        spark, path = _STAGED.pop()
        with contextlib.suppress(Exception):  # the context may have stopped already
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def released() -> Iterator[None]:
    """What is staged within the block is deleted at its end."""
    kept = len(_STAGED)
    try:
        yield
    finally:
        release_staged(kept)


atexit.register(release_staged)
