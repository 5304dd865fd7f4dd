"""Running, rolling and whole-group aggregates over ordered groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import staged
from .groups import OrderedGroups
from .joins import left_join_null_safe
from .places import numbered


@dataclass(frozen=True)
class Running:
    """One aggregate over a ROWS frame; ``None`` bounds are unbounded."""

    fn: str
    column: str | None = None
    start: int | None = None
    end: int | None = 0

    @property
    def whole(self) -> bool:
        return self.start is None and self.end is None

    @property
    def sliding(self) -> bool:
        return self.start is not None


def last(n: int, fn: str, column: str) -> Running:
    """Aggregate over the current row and the n - 1 rows before it."""
    return Running(fn, column, 1 - n, 0)


def so_far(fn: str, column: str | None = None) -> Running:
    """Aggregate over all rows up to and including the current one."""
    return Running(fn, column, None, 0)


def before(fn: str, column: str | None = None) -> Running:
    """Aggregate over all rows before the current one."""
    return Running(fn, column, None, -1)


def whole(fn: str, column: str) -> Running:
    """Aggregate over the whole group, the same on each of its rows."""
    return Running(fn, column, None, None)


def row_number() -> Running:
    return Running("row_number")


def peak(column: str) -> Running:
    """The greatest running sum of ``column`` in the whole group, the same on each of its rows."""
    return Running("peak", column, None, None)


Split = tuple[OrderedGroups, dict[str, Running]]


def add_running(df: DataFrame, groups: OrderedGroups, features: dict[str, Running]) -> DataFrame:
    """Add one column per feature to every row of ``df``."""
    return add_all(df, [(groups, features)])


def add_all(df: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """Add the features of several splits of ``df`` into groups, all of them from columns of ``df``.

    Splits without cut groups are plain windows. For the others the rows go through one shuffle
    each, by (keys, block), and get windows that stay within their block. The result is
    written once, whatever the number of splits: the last rows of all blocks, which hold the
    blocks' totals, come out of one scan of it, and a second scan puts every row together
    with what the other blocks of its group carry over.

    Splits cut by places are numbered before any window is made, and completed one after the other.
    """
    if any(groups.block_rows for groups, _ in splits):
        return _add_by_places(df, splits)
    rows, blocks = df, []
    for j, (groups, features) in enumerate(splits):
        if groups.cut:
            blocks.append(_Blocks(f"_r{j}_", groups, features))
            rows = blocks[-1].local(rows)
        else:
            rows = _plain(rows, groups, features)
    if not blocks:
        return rows
    local = staged(rows, "block-windows")
    needed = list(dict.fromkeys(c for b in blocks for c in b.needed))
    ends = staged(local.filter(reduce(or_, [b.near_end for b in blocks])).select(needed), "block-ends")
    out = local
    for b in blocks:
        out = left_join_null_safe(out, b.carried(ends), b.keys)
    finished = {n: c for b in blocks for n, c in b.finished().items()}
    names = list(dict.fromkeys([*df.columns, *[n for _, features in splits for n in features]]))
    return out.select(*[finished[n].alias(n) if n in finished else F.col(n) for n in names])


def _add_by_places(df: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """`add_all` where some splits are cut by the places of their rows."""
    placed = [_Places(f"_p{j}_", groups, features) for j, (groups, features) in enumerate(splits) if groups.block_rows]
    rows = df
    for p in placed:
        rows = numbered(rows, [*p.groups.keys, *p.groups.order], p.place)
    scan = rows
    for p in placed:
        rows = p.added(rows, scan)
    rows = add_all(rows, others) if (others := [s for s in splits if not s[0].block_rows]) else rows
    added = {n: p.prefix + n for p in placed for n in p.features}
    names = list(dict.fromkeys([*df.columns, *[n for _, features in splits for n in features]]))
    return rows.select(*[F.col(added.get(n, n)).alias(n) for n in names])


def _lower(f: Running) -> int:
    return Window.unboundedPreceding if f.start is None else f.start


_NATIVE = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev}


def _native(f: Running, frame) -> Column:
    return (F.count(f.column or F.lit(1)) if f.fn == "count" else _NATIVE[f.fn](f.column)).over(frame)


def _plain(df: DataFrame, groups: OrderedGroups, features: dict[str, Running]) -> DataFrame:
    group = Window.partitionBy(*groups.keys)
    ordered = group.orderBy(*groups.order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    columns, sums = {}, {f"_peak_{f.column}": F.sum(f.column).over(upto) for f in features.values() if f.fn == "peak"}
    for name, f in features.items():
        if f.fn == "row_number":
            columns[name] = F.row_number().over(ordered)
        elif f.fn == "peak":
            columns[name] = F.max(f"_peak_{f.column}").over(group)
        else:
            columns[name] = _native(f, group if f.whole else ordered.rowsBetween(_lower(f), f.end))
    return (df.withColumns(sums) if sums else df).withColumns(columns).drop(*sums)


# Cut groups: every aggregate is put together from parts that add up across blocks.

@dataclass(frozen=True)
class _Part:
    """A mergeable part of an aggregate: how two of them combine, and what one row contributes."""

    how: str
    column: str | None

    @property
    def name(self) -> str:
        return f"{self.how}_{self.column}" if self.column else "rows"

    @property
    def row(self) -> Column:
        if self.column is None:
            return F.lit(1).cast("bigint")
        c = F.col(self.column)
        if self.how == "count":
            return F.when(c.isNotNull(), 1).otherwise(0).cast("bigint")
        return c.cast("double") if self.how == "moments" else c

    def over(self, frame, row: str) -> Column:
        """The part of the rows in ``frame``, or of a whole aggregate's rows without one."""
        over = lambda c: c if frame is None else c.over(frame)
        if self.how == "moments":
            n = over(F.count(row))
            return _moments(n, over(F.avg(row)), over(F.var_pop(row)) * n)
        return over({"min": F.min, "max": F.max}.get(self.how, F.sum)(row))

    def combine(self, a: Column, b: Column) -> Column:
        if self.how in ("min", "max"):
            return F.least(a, b) if self.how == "min" else F.greatest(a, b)
        if self.how != "moments":
            return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        n, away = a["n"] + b["n"], b["mean"] - a["mean"]
        both = _moments(n, a["mean"] + away * b["n"] / n, a["m2"] + b["m2"] + away * away * a["n"] * b["n"] / n)
        return F.when(b.isNull() | (b["n"] == 0), a).when(a.isNull() | (a["n"] == 0), b).otherwise(both)

    def of_values(self, values: Column) -> Column:
        """The part of an array of what single rows contribute."""
        if self.how in ("min", "max"):
            return F.array_min(values) if self.how == "min" else F.array_max(values)
        known = F.filter(values, lambda v: v.isNotNull())
        total = lambda of: F.aggregate(of, F.get(of, F.lit(0)) - F.get(of, F.lit(0)), lambda t, v: t + v)
        if self.how != "moments":
            return total(known)
        n = F.size(known).cast("bigint")
        mean = total(known) / F.nullif(n, F.lit(0))
        return _moments(n, mean, total(F.transform(known, lambda v: (v - mean) * (v - mean))))

    def over_blocks(self, total: str, group, frame) -> Column:
        """The part of all blocks in ``frame`` of ``group`` (ordered blocks), out of the blocks' own."""
        if self.how != "moments":
            return {"min": F.min, "max": F.max}.get(self.how, F.sum)(total).over(frame)
        # Away from the mean of the first block, so that large values don't drown their spread.
        center = F.first(F.col(total)["mean"], ignorenulls=True).over(group)
        n, away = F.col(total)["n"], F.coalesce(F.col(total)["mean"] - center, F.lit(0.0))
        rows, first = F.sum(n).over(frame), F.sum(n * away).over(frame)
        second = F.sum(F.coalesce(F.col(total)["m2"], F.lit(0.0)) + n * away * away).over(frame)
        some = F.nullif(rows, F.lit(0))
        return _moments(F.coalesce(rows, F.lit(0)), center + first / some, F.greatest(second - first * first / some, F.lit(0.0)))


def _moments(n: Column, mean: Column, m2: Column) -> Column:
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))


def _parts(f: Running) -> list[_Part]:
    if f.fn == "row_number" or f.column is None:
        return [_Part("count", None)]
    if f.fn in ("sum", "avg", "peak"):
        return [_Part("count", f.column), _Part("sum", f.column)]
    return [_Part("moments" if f.fn == "stddev" else f.fn, f.column)]


def _finish(f: Running, parts: list[Column]) -> Column:
    if f.fn == "stddev":
        n, m2 = parts[0]["n"], parts[0]["m2"]
        return F.when(n > 1, F.sqrt(m2 / (n - 1)))
    if f.fn in ("sum", "avg"):
        return F.when(parts[0] > 0, parts[1] if f.fn == "sum" else parts[1] / parts[0])
    return parts[0].cast("int") if f.fn == "row_number" else parts[0]


class _Blocks:
    """Windows per (keys, block) of one split, completed by what the other blocks of the group carry over."""

    def __init__(self, prefix: str, groups: OrderedGroups, features: dict[str, Running]):
        self.prefix, self.groups, self.features = prefix, groups, features
        self.block, self.cut, self.nth, self.rest = (prefix + n for n in ("block", "cut", "nth", "rest"))
        self.keys = [*groups.keys, self.block]
        self.reach = max((-f.start for f in features.values() if f.sliding), default=0)
        self.totals = list(dict.fromkeys(p for f in features.values() if not f.sliding for p in _parts(f)))
        self.slid = list(dict.fromkeys(p for f in features.values() if f.sliding for p in _parts(f)))
        self.peaks = {f.column for f in features.values() if f.fn == "peak"}
        rows = list(dict.fromkeys([*self.totals, *self.slid]))
        self.rows = {p: f"{prefix}row_{p.name}" for p in rows}

    def _of(self, kind: str, what: str) -> str:
        return f"{self.prefix}{kind}_{what}"

    @property
    def near_end(self) -> Column:
        return F.col(self.cut) & (F.col(self.rest) < max(self.reach, 1))

    @property
    def needed(self) -> list[str]:
        totals = [self._of("total", p.name) for p in self.totals] + [self._of("peak", c) for c in sorted(self.peaks)]
        return [*self.keys, self.cut, self.rest, *totals, *[self.rows[p] for p in self.slid]]

    def local(self, df: DataFrame) -> DataFrame:
        """Only the rows themselves are shuffled: parts are added behind the shuffle."""
        rows = self.groups.with_block(df, self.block, self.cut).repartition(*self.keys)
        rows = rows.withColumns({name: p.row for p, name in self.rows.items()})
        block = Window.partitionBy(*self.keys)
        in_order = block.orderBy(*self.groups.order)
        upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
        columns = {self.nth: F.row_number().over(in_order), self.rest: F.count("*").over(block) - F.row_number().over(in_order)}
        columns |= {self._of("total", p.name): p.over(upto, self.rows[p]) for p in self.totals}
        for name, f in self.features.items():
            frame = block if f.whole else in_order.rowsBetween(_lower(f), f.end)
            columns |= {self._of(name, p.name): p.over(frame, self.rows[p]) for p in _parts(f) if f.fn != "peak"}
        rows = rows.withColumns(columns)
        return rows.withColumns({self._of("peak", c): F.max(self._of("total", f"sum_{c}")).over(block) for c in sorted(self.peaks)}) if self.peaks else rows

    def carried(self, ends: DataFrame) -> DataFrame:
        """One row per block of a cut group: parts before it, parts of all other blocks, last rows before it.

        ``ends`` are the last rows of blocks: one of them, or as many as a sliding frame reaches back.
        """
        first = lambda c: F.min_by(c, self.rest).alias(c)
        totals = [self._of("total", p.name) for p in self.totals] + [self._of("peak", c) for c in sorted(self.peaks)]
        last_rows = F.struct((-F.col(self.rest)).alias("at"), *[F.col(self.rows[p]).alias(p.name) for p in self.slid])
        end_rows = F.array_sort(F.collect_list(last_rows)).alias("end_rows")
        blocks = ends.filter(self.near_end).groupBy(*self.keys).agg(F.count("*").alias("ends"), *[first(c) for c in totals], *([end_rows] if self.reach else []))
        group = Window.partitionBy(*self.groups.keys).orderBy(self.block)
        earlier = group.rowsBetween(Window.unboundedPreceding, -1)
        # From the other end, as a frame that ends with the group is added up anew for each of its rows.
        later = Window.partitionBy(*self.groups.keys).orderBy(F.desc(self.block)).rowsBetween(Window.unboundedPreceding, -1)
        columns = {}
        for p in self.totals:
            total = self._of("total", p.name)
            columns[self._of("before", p.name)] = p.over_blocks(total, group, earlier)
            columns[self._of("others", p.name)] = p.combine(p.over_blocks(total, group, earlier), p.over_blocks(total, group, later))
        if self.reach:
            columns["_tail"] = F.flatten(F.collect_list("end_rows").over(group.rowsBetween(-self.reach, -1)))
        blocks = blocks.withColumns(columns) if columns else blocks
        for c in sorted(self.peaks):
            top = F.coalesce(F.col(self._of("before", f"sum_{c}")), F.lit(0)) + F.col(self._of("peak", c))
            columns[self._of("top", c)] = top
            blocks = blocks.withColumn(self._of("top", c), F.max(top).over(Window.partitionBy(*self.groups.keys)))
        tails = [self._tail(p).alias(self._of("tail", p.name)) for p in self.slid]
        return blocks.select(*self.keys, *[c for c in columns if c != "_tail"], *tails)

    def _tail(self, part: _Part) -> Column:
        """Array whose n-th element combines ``part`` over the last n rows of the earlier blocks."""
        tail = F.col("_tail")
        values = F.transform(tail, lambda r: r[part.name])
        return F.transform(F.sequence(F.lit(1), F.lit(self.reach)),
                           lambda n: part.of_values(F.slice(values, F.greatest(F.size(tail) - n + 1, F.lit(1)), n)))

    def finished(self) -> dict[str, Column]:
        out = {}
        for name, f in self.features.items():
            if f.fn == "peak":
                out[name] = F.coalesce(self._of("top", f.column), self._of("peak", f.column))
                continue
            whole = []
            for p in _parts(f):
                if f.sliding:
                    # The n-th row of a block lacks (window - n) rows, if any; out of range reads as null.
                    other = F.get(self._of("tail", p.name), -f.start - F.col(self.nth))
                else:
                    other = F.col(self._of("others" if f.whole else "before", p.name))
                whole.append(p.combine(F.col(self._of(name, p.name)), other))
            out[name] = _finish(f, whole)
        return out


class _Places:
    """Windows per (keys, block) of one split whose blocks are so many places each, in the order of its groups.

    The rows of a group in one block are a piece. What the other pieces of its group carry over is known
    before the windows are made: totals come from one aggregate of the rows as read, and the rows
    that sliding frames reach back to are sent to the block as well. So a row moves once, with its
    own columns only, to the task where it gets its windows and what completes them.
    """

    def __init__(self, prefix: str, groups: OrderedGroups, features: dict[str, Running]):
        self.prefix, self.groups, self.features = prefix, groups, features
        self.place, self.block, self.start, self.first, self.last = (prefix + n for n in ("place", "block", "start", "first", "last"))
        self.reach = max((-f.start for f in features.values() if f.sliding), default=0)
        self.totals = list(dict.fromkeys(p for f in features.values() if not f.sliding for p in _parts(f)))
        self.peaks = sorted({f.column for f in features.values() if f.fn == "peak"})

    def _of(self, kind: str, part: _Part | str) -> str:
        return f"{self.prefix}{kind}_{part if isinstance(part, str) else part.name}"

    def _local(self, part: _Part, f: Running) -> str:
        return self._of("whole" if f.whole else f"upto{f.end}", part)

    def _number(self, place: Column) -> Column:
        return F.floor(place / self.groups.block_rows)

    def pieces(self, scan: DataFrame) -> DataFrame:
        """The totals of every piece at an edge of its block; no other piece belongs to a group that is cut."""
        number = self._number(F.col(self.place)).alias(self.block)
        rows = scan.select(*self.groups.keys, self.place, number, *[p.row.alias(self._of("row", p)) for p in self.totals])
        if self.peaks:
            rows = rows.repartition(self.block)
            upto = Window.partitionBy(self.block, *self.groups.keys).orderBy(self.place).rowsBetween(Window.unboundedPreceding, 0)
            rows = rows.withColumns({self._of("peak", c): F.sum(self._of("row", f"sum_{c}")).over(upto) for c in self.peaks})
        pieces = rows.groupBy(self.block, *self.groups.keys).agg(
            F.min(self.place).alias(self.first), F.max(self.place).alias(self.last),
            *[p.over(None, self._of("row", p)).alias(self._of("total", p)) for p in self.totals],
            *[F.max(self._of("peak", c)).alias(self._of("peak", c)) for c in self.peaks])
        n = self.groups.block_rows
        return pieces.where((F.col(self.first) % n == 0) | ((F.col(self.last) + 1) % n == 0))

    def carried(self, scan: DataFrame) -> DataFrame:
        """Block and first place of such pieces, with parts of the pieces before it, parts and peaks of the whole group."""
        pieces = self.pieces(scan)
        group = Window.partitionBy(*self.groups.keys).orderBy(self.block)
        before = group.rowsBetween(Window.unboundedPreceding, -1)
        every = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        columns = {}
        for f in self.features.values():
            for p in [] if f.sliding else _parts(f):
                kind, frame = ("all", every) if f.whole and f.fn != "peak" else ("before", before)
                columns[self._of(kind, p)] = p.over_blocks(self._of("total", p), group, frame)
        pieces = pieces.withColumns(columns)
        for c in self.peaks:
            top = F.coalesce(F.col(self._of("before", f"sum_{c}")), F.lit(0)) + F.col(self._of("peak", c))
            pieces = pieces.withColumn(self._of("top", c), F.max(top).over(every))
        return pieces.select(self.block, self.first, *columns, *[self._of("top", c) for c in self.peaks])

    def added(self, rows: DataFrame, scan: DataFrame) -> DataFrame:
        """``rows`` with every feature, named with the prefix."""
        kept, place = rows.columns, F.col(self.place)
        # Later blocks within reach get the row as well, with the columns that frames see.
        blocks = F.explode(F.sequence(self._number(place), self._number(place + self.reach))) if self.reach else self._number(place)
        own = F.col(self.block) == self._number(place)
        seen = {*self.groups.keys, self.place, *[f.column for f in self.features.values() if f.sliding]}
        rows = rows.withColumn(self.block, blocks)
        rows = rows.select(self.block, *[F.col(c) if c in seen or not self.reach else F.when(own, F.col(c)).alias(c) for c in kept]).repartition(self.block)
        rows = rows.withColumns({self._of("row", p): F.when(own, p.row) for p in self.totals})
        in_order = Window.partitionBy(self.block, *self.groups.keys).orderBy(self.place)
        upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
        piece = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        columns = {self.start: F.min(F.when(own, place)).over(upto)}
        columns |= {self._of("peak", c): F.sum(self._of("row", f"sum_{c}")).over(upto) for c in self.peaks}
        for name, f in self.features.items():
            if f.sliding:
                columns[self.prefix + name] = _native(f, in_order.rowsBetween(f.start, f.end))
                continue
            frame = piece if f.whole else in_order.rowsBetween(Window.unboundedPreceding, f.end)
            columns |= {self._local(p, f): p.over(frame, self._of("row", p)) for p in _parts(f) if f.fn != "peak"}
        rows = rows.withColumns(columns)
        rows = rows.withColumns({self._of("peak", c): F.max(self._of("peak", c)).over(piece) for c in self.peaks}) if self.peaks else rows
        rows = rows.where(own)
        if self.totals:
            # Equal in the block alone, by which the rows are dealt already; a block has two such pieces at most.
            at = F.col(f"l.{self.block}") == F.col(f"r.{self.block}")
            same = F.col(f"l.{self.start}").between(F.col(f"r.{self.first}"), F.col(f"r.{self.first}"))
            carried = self.carried(scan)
            joined = rows.alias("l").join(carried.alias("r"), at & same, "left")
            rows = joined.select("l.*", *[F.col(f"r.{c}") for c in carried.columns if c != self.block])
        return rows.select(*kept, *[c.alias(self.prefix + name) for name, c in self._finished().items()])

    def _finished(self) -> dict[str, Column]:
        out, carried = {}, F.col(self.first).isNotNull()
        for name, f in self.features.items():
            if f.sliding:
                out[name] = F.col(self.prefix + name)
            elif f.fn == "peak":
                out[name] = F.coalesce(self._of("top", f.column), self._of("peak", f.column))
            elif f.whole:
                out[name] = _finish(f, [F.when(carried, F.col(self._of("all", p))).otherwise(F.col(self._local(p, f))) for p in _parts(f)])
            else:
                out[name] = _finish(f, [p.combine(F.col(self._local(p, f)), F.col(self._of("before", p))) for p in _parts(f)])
        return out
