"""Joins whose broadcasts rest on a checked size."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import max_pinned_rows


def pinned(df: DataFrame) -> DataFrame:
    """Make a small table a broadcast side, if it really is small.

    At most ``max_pinned_rows`` + 1 rows reach the driver. A bigger table comes
    back unchanged, and joins against it shuffle (with adaptive skew handling).
    """
    spark = df.sparkSession
    limit = max_pinned_rows(spark)
    rows = df.take(limit + 1)
    if len(rows) > limit:
        return df
    return F.broadcast(spark.createDataFrame(rows, df.schema))


def lookup(df: DataFrame, small: DataFrame, on: list[str], nulls_match: bool = False) -> DataFrame:
    """Left join against a per-key table, broadcast only if it is small. [J7]

    With ``nulls_match`` rows without a key find the table's row without a key,
    as they would share a window partition.
    """
    small = pinned(small)
    return left_join_null_safe(df, small, on) if nulls_match else df.join(small, on, "left")


def left_join_null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left equi-join in which null keys equal each other; adds the right's other columns."""
    condition = reduce(and_, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on])
    joined = left.alias("l").join(right.alias("r"), condition, "left")
    return joined.select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in on])


def latest(df: DataFrame, column: str) -> DataFrame:
    """Rows with the greatest value of ``column``. [A7, J9]

    The maximum is a scalar subquery, one row by construction, that runs before the scan, which
    then skips partitions or row groups by it.
    """
    return df.filter(F.col(column) == df.agg(F.max(column)).scalar())
