"""Top-k selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str], k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1. [T7, T10]

    Filtering on row_number lets Spark keep only k rows per group before the
    shuffle, so the size of a group does not matter.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, n).filter(F.col(name) <= k)


def top_rows(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows overall. [T3, T4, T5, T11]"""
    return df.orderBy(*order).limit(k)
