"""Ordered groups that stay parallel when one group holds a large share of the rows.

A window over ``keys`` ordered by ``order`` puts each group into one task. Groups
too big for that are cut, along the order, into consecutive blocks; windows then
run per (keys, block), and what the earlier blocks of the group contribute comes
back as one small row per block (see ``running``). Where the cuts fall never
changes a result, so approximate statistics are enough to choose them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import max_group_rows
from ..sources.scratch import staged
from .heavy import MAX_KEYS, heavy_keys
from .joins import left_join_null_safe
from .places import numbered

#: Tables of more blocks than this are cut by the exact places of their rows, without sketches and broadcasts.
MAX_BLOCKS = MAX_KEYS
SAMPLES_PER_BLOCK = 64
HASH = "_group_hash"
CUTS = "_cuts"
BLOCK = "_block"
#: Whether the group of a row is cut.
CUT = "_cut"

Split = tuple[Sequence[str], Sequence[str]]


@dataclass(frozen=True)
class OrderedGroups:
    """Groups by ``keys`` in a total ``order`` (ascending), and how the big ones are cut.

    Nothing is cut when every group fits one task. ``cuts`` has one row for each big group with
    its sorted cut points, of which there are at most twice ``MAX_BLOCKS`` in all, ``longest`` for
    one group. With ``block_rows`` every so many rows of the whole table, in the order of its
    groups, are a block instead; their number has no bound.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    cuts: DataFrame | None = None
    longest: int = 0
    block_rows: int = 0

    @property
    def cut(self) -> bool:
        return self.cuts is not None or self.block_rows > 0

    def with_block(self, df: DataFrame, block: str = BLOCK, cut: str = CUT) -> DataFrame:
        """Add the block number and whether the row's group is cut; uncut groups may have one block number for all."""
        if self.block_rows:
            return self._by_place(df, block, cut)
        if self.cuts is None:
            return df.withColumns({block: F.lit(0).cast("long"), cut: F.lit(False)})
        number = _cuts_up_to(F.col(CUTS), F.struct(*self.order), self.longest)
        return (
            df.withColumn(HASH, F.xxhash64(*self.keys))
            .join(F.broadcast(self.cuts), HASH, "left")
            .withColumns({block: F.when(F.col(CUTS).isNull(), F.lit(0)).otherwise(number).cast("long"), cut: F.col(CUTS).isNotNull()})
            .drop(HASH, CUTS)
        )

    def _by_place(self, df: DataFrame, block: str, cut: str) -> DataFrame:
        rows = numbered(df, [*self.keys, *self.order], block)
        place = F.pmod(F.col(block), F.lit(self.block_rows))
        number = F.floor(F.col(block) / self.block_rows)
        # Groups that go on behind the last row of a block: the next block starts with the same keys.
        last = rows.where(place == self.block_rows - 1).select(*self.keys, (number + 1).alias(block))
        first = rows.where(place == 0).select(*self.keys, number.alias(block))
        both = left_join_null_safe(last, first.withColumn(cut, F.lit(True)), [*self.keys, block]).where(cut)
        broken = staged(both.select(*self.keys, cut).distinct(), "broken-groups")
        return left_join_null_safe(rows.withColumn(block, number), broken, list(self.keys)).withColumn(cut, F.coalesce(cut, F.lit(False)))


def _cuts_up_to(cuts: Column, position: Column, longest: int) -> Column:
    """Number of sorted ``cuts``, at most ``longest``, that are <= ``position`` (binary search)."""
    steps = [1 << b for b in reversed(range(longest.bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda low, step: F.when(F.get(cuts, low + step - 1) <= position, low + step).otherwise(low),
    )


def ordered_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_at_most: int | None = None
) -> OrderedGroups:
    """`all_ordered_groups` for one split."""
    return all_ordered_groups(df, [(keys, order)], rows_at_most)[0]


def all_ordered_groups(df: DataFrame, splits: Sequence[Split], rows_at_most: int | None = None) -> list[OrderedGroups]:
    """For each (keys, order) the groups that are too big for one task, and their cuts.

    ``df`` should be a scan (a source or a staged table): one narrow pass looks for big groups of
    all splits, another one places the cuts of a split that has any, and none runs when there
    are no more rows than one task may take. ``rows_at_most`` saves the count when a bound is
    already known.
    """
    limit = max_group_rows(df.sparkSession)
    total = df.count() if rows_at_most is None else rows_at_most
    plain = [OrderedGroups(tuple(k), tuple(o)) for k, o in splits]
    if total <= limit:
        return plain
    if total > limit * MAX_BLOCKS:
        return [OrderedGroups(g.keys, g.order, block_rows=limit) for g in plain]
    return [_with_cuts(df, g, big, limit) if big else g for g, big in zip(plain, heavy_keys(df, [k for k, _ in splits], limit))]


def _with_cuts(df: DataFrame, groups: OrderedGroups, big: dict[int, int], limit: int) -> OrderedGroups:
    """Quantiles of the order inside each big group, from a sample that only places cuts, as a written table."""
    hashed = df.select(F.xxhash64(*groups.keys).alias(HASH), F.struct(*groups.order).alias("cut"))
    blocks = {h: -(-n // limit) for h, n in big.items()}
    wanted = F.broadcast(
        df.sparkSession.createDataFrame(list(blocks.items()), f"{HASH} bigint, blocks bigint")
    )
    fraction = min(1.0, SAMPLES_PER_BLOCK * sum(blocks.values()) / sum(big.values()))
    group = Window.partitionBy(HASH)
    bucket = F.floor((F.row_number().over(group.orderBy("cut")) - 1) * F.col("blocks") / F.count("*").over(group))
    edges = (
        hashed.join(wanted, HASH)
        .sample(fraction, seed=17)
        .select(HASH, "cut", bucket.alias("bucket"))
        .groupBy(HASH, "bucket")
        .agg(F.min("cut").alias("cut"))
        .filter("bucket > 0")
    )
    cuts = staged(edges.groupBy(HASH).agg(F.array_sort(F.collect_list("cut")).alias(CUTS)), "cuts")
    longest = cuts.agg(F.max(F.size(CUTS))).first()[0]
    return OrderedGroups(groups.keys, groups.order, cuts, longest) if longest else groups
