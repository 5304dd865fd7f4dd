"""Places in a total order, found by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .joins import left_join_null_safe

_ROW_BITS = 33  # of monotonically_increasing_id, below the number of the partition


def numbered(df: DataFrame, order: list[Column | str], name: str, table: str = "in-order") -> DataFrame:
    """``df`` as a written table with ``name``, the place of each row in ``order``, from 0.

    Rows are dealt out by ranges of the order and counted from the start of their range; how
    many rows come before each range is a running sum over one row for each of them. No task
    sees more than its range. ``df`` should be a scan, as its ranges are sampled first; rows that
    tie get places in any one order.
    """
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = staged(cut.withColumn(name, F.monotonically_increasing_id()), table)
    part = F.shiftright(F.col(name), _ROW_BITS)
    counts = cut.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    starts = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    rows = cut.withColumn("_range", part).join(F.broadcast(starts), "_range")  # a row for each range
    return rows.select(*df.columns, (F.col("_start") + F.col(name).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).alias(name))


def dense_ranks(df: DataFrame, keys: list[str], by: Column, name: str) -> DataFrame:
    """``keys``, ``by`` (as ``_by``) and the dense rank of each distinct value of ``by`` within its keys, from 1.

    Distinct values collapse on the map side and get their places in one order over all keys; a
    rank is the distance to the first place of its keys, an aggregate of one row for each of them.
    """
    values = staged(df.select(*keys, by.alias("_by")).distinct(), "distinct-values")
    places = numbered(values, [*keys, "_by"], "_place", "ranked-values")
    first = places.groupBy(*keys).agg(F.min("_place").alias("_first"))
    ranked = left_join_null_safe(places, first, keys)
    return ranked.select(*keys, "_by", (F.col("_place") - F.col("_first") + 1).cast("int").alias(name))
