"""Keys that hold many rows, found in one pass, and joins that spread them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import max_group_rows

# A frequent-items sketch of this size is sure to report every key above total / MAX_KEYS rows.
TRACKED_ITEMS = 40_000
MAX_KEYS = 8_000
SKETCH_MERGERS = 64
#: A hot key's rows go to so many times the tasks that could just hold them.
SPREAD = 4
_HASH, _PARTS, _PART = "_key_hash", "_key_parts", "_key_part"


def heavy_keys(df: DataFrame, key_sets: Sequence[Sequence[str]], limit: int) -> list[dict[int, int]]:
    """For each set of key columns the estimated rows of every key above ``limit``, by the hash of the key.

    One narrow pass without a shuffle of the keys: each task sends one sketch for each set, and
    the sketches are merged by a fixed number of tasks before the last one. No key above ``limit`` or
    a part in ``MAX_KEYS`` of the rows, whichever is more, is missed.
    """
    hashed = df.select(*[F.xxhash64(*keys).alias(f"h{j}") for j, keys in enumerate(key_sets)])
    merger = F.pmod(F.spark_partition_id(), F.lit(SKETCH_MERGERS)).alias("merger")
    each = range(len(key_sets))
    found = (
        hashed.groupBy(merger)
        .agg(*[F.expr(f"approx_top_k_accumulate(h{j}, {TRACKED_ITEMS})").alias(f"s{j}") for j in each])
        .groupBy(F.lit(0).alias("all"))
        .agg(*[F.expr(f"approx_top_k_combine(s{j}, {TRACKED_ITEMS})").alias(f"s{j}") for j in each])
        .select(*[F.filter(F.expr(f"approx_top_k_estimate(s{j}, {MAX_KEYS})"), lambda g: g["count"] > limit).alias(f"s{j}") for j in each])
    ).first()
    return [{g["item"]: g["count"] for g in found[f"s{j}"]} if found else {} for j in each]


@dataclass(frozen=True)
class HotKeys:
    """Keys too big for one task, by hash, with the number of parts their rows are dealt to."""

    on: tuple[str, ...]
    parts: dict[int, int]

    def table(self, df: DataFrame) -> DataFrame:
        rows = df.sparkSession.createDataFrame(list(self.parts.items()), f"{_HASH} bigint, {_PARTS} int")
        return df.withColumn(_HASH, F.xxhash64(*self.on)).join(F.broadcast(rows), _HASH, "left").drop(_HASH)  # at most MAX_KEYS rows


def hot_keys(df: DataFrame, key_sets: Sequence[Sequence[str]]) -> list[HotKeys]:
    """The hot keys of a scan for each set of key columns."""
    limit = max_group_rows(df.sparkSession)
    found = heavy_keys(df, key_sets, limit)
    return [HotKeys(tuple(keys), {h: SPREAD * -(-n // limit) for h, n in big.items()}) for keys, big in zip(key_sets, found)]


def spread_join(left: DataFrame, right: DataFrame, hot: HotKeys) -> DataFrame:
    """Left join on the keys of ``hot``, whose rows are on the left. [J1-J6]

    Rows of a hot key are dealt to several parts by a hash of the whole row, and the few rows of
    the other side with that key are repeated for each part. Other keys have one part. Rows
    without a key find nothing, and are dealt out as well when there are many.
    """
    if not hot.parts:
        return left.join(right, list(hot.on), "left")
    plain = [c for c, kind in left.dtypes if not kind.startswith("map")]
    part = F.coalesce(F.pmod(F.xxhash64(*plain), F.col(_PARTS)), F.lit(0)).cast("int")
    dealt = hot.table(left).withColumn(_PART, part).drop(_PARTS)
    every = F.explode(F.sequence(F.lit(0), F.coalesce(_PARTS, F.lit(1)) - 1))
    repeated = hot.table(right).withColumn(_PART, every).drop(_PARTS)
    return dealt.join(repeated, [*hot.on, _PART], "left").drop(_PART)
