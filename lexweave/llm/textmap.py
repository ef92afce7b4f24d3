"""Batch functions over the text column; ids stay on the JVM side, whatever their nulls or width."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.session import ship

CHARS_A_SLICE = 2_000_000


def slices(texts: pd.Series) -> Iterator[pd.Series]:
    """A batch in stretches of bounded text, however long its texts are."""
    sizes = texts.str.len().fillna(0).cumsum() // CHARS_A_SLICE
    for _, part in texts.groupby(sizes, sort=False):
        yield part


def map_texts(docs: DataFrame, id_col: str, text: str, run: Callable[[pd.Series], pd.DataFrame], schema: str, also: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the columns `also` and those of `schema`, which `run` makes from a batch of texts (None for null)."""
    ship(docs.sparkSession)

    @F.pandas_udf(schema)
    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from map(run, slices(batch))

    extra = [c.alias(name) for name, c in (also or {}).items()]
    return docs.select(F.col(id_col).alias("doc_id"), *extra, mapped(F.col(text)).alias("_lw_r")).select("doc_id", *(also or {}), "_lw_r.*")
