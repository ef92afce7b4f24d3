"""Publishing of a run: a folder appears whole under its name, with a manifest of what it holds."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, out: str, build: Callable[[str], None]) -> None:
    """Let `build` fill `out`.tmp, then put it in the place of `out`; a failed build leaves `out` as it was."""
    (done, fs), (target, _) = _path(spark, f"{out}.tmp"), _path(spark, out)
    fs.delete(done, True)
    build(f"{out}.tmp")
    fs.delete(target, True)
    if not fs.rename(done, target):
        raise OSError(f"cannot publish {out}")


def write_manifest(spark: SparkSession, folder: str, manifest: dict) -> None:
    """`folder`/manifest: one JSON line."""
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
