"""Mixing sources to target weights by Pfair scheduling, as expressions on a schedule of sources and phases."""

from __future__ import annotations

import json
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged

#: Rows of one block, the unit that is scheduled.
BLOCK_ROWS = 16
#: Parts of the mixture; sources that are not named get one part.
TARGET_PARTS = {"src0": 6, "src1": 4, "src2": 3, "src3": 2}
#: Schedules of up to so many (source, phase) pairs are broadcast, at about 100 bytes each; others are joined block by block.
MAX_PAIRS = 20_000
_BUCKET_ROWS = 50_000


def _period(parts: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Slots of sources with the given parts, in the order of their names, in one period by earliest deadline first.

    Block k (from 0) of a source with c of L parts is released at floor(k L / c) and due at
    ceil((k + 1) L / c); of the released blocks the one with the earliest deadline gets a slot, names
    breaking ties. As blocks are one slot long, each gets the first slot from its release on
    that no block before it in the order of (deadline, name) has. All blocks but the last of each
    source are placed one by one so; the last ones are all due at L, where those of sources with one
    part take the free slots in a row. Gives the slot of each source with one part, by its place,
    and the slots of each other source.
    """
    total, many = int(parts.sum()), np.flatnonzero(parts > 1)
    after: dict[int, int] = {}

    def free(t: int) -> int:
        path = []
        while t in after:
            path.append(t)
            t = after[t]
        after.update(dict.fromkeys(path, t))
        return t

    slots: dict[int, list[int]] = {int(s): [] for s in many}
    early = sorted((-(-(k + 1) * total // int(parts[s])), int(s), k) for s in many for k in range(int(parts[s]) - 1))
    for _, s, k in early:
        t = free(k * total // int(parts[s]))
        after[t] = t + 1
        slots[s].append(t)
    open_ = np.ones(total, bool)
    open_[list(after)] = False
    left = np.flatnonzero(open_)
    for before, s in enumerate(many.tolist()):
        # ``s - before`` sources with one part come first by name and have the first slots.
        c = int(parts[s])
        at = max(int(np.searchsorted(left, (c - 1) * total // c)), s - before)
        slots[s].append(int(left[at]))
        left = np.delete(left, at)
    single = np.full(len(parts), -1, np.int64)
    single[parts == 1] = left
    return single, {s: np.array(sorted(t), np.int64) for s, t in slots.items()}


def phases(blocks: Mapping[str, int], parts: Mapping[str, int]) -> dict[str, list[tuple]]:
    """For each source its phases (first block, last block + 1, first slot, parts, period, slots in the period).

    A phase ends when a source has no block left; the others go on with their parts among
    those that remain. A source has an entry for each phase in which it gets a block. Work
    follows the number of sources times that of phases, in whole arrays, and never the rows.
    Sources with zero parts come last, in equal parts.
    """
    names = sorted(s for s, n in blocks.items() if n > 0)
    left = np.array([blocks[s] for s in names], np.int64)
    wanted = np.array([parts.get(s, 1) for s in names], np.int64)
    taken, start, out = np.zeros(len(names), np.int64), 0, {s: [] for s in blocks}
    while (left > 0).any():
        now = np.flatnonzero((left > 0) & (wanted > 0))
        own = wanted[now]
        if not len(now):
            now = np.flatnonzero(left > 0)
            own = np.ones(len(now), np.int64)
        own = own // np.gcd.reduce(own)
        length = int(own.sum())
        single, many = _period(own)
        ends = (left[now] - 1) * length + single + 1
        for s, t in many.items():
            n, c = int(left[now[s]]) - 1, len(t)
            ends[s] = n // c * length + t[n % c] + 1
        span = int(ends.min())
        got = span // length * own + (single < span % length)
        for s, t in many.items():
            got[s] = span // length * len(t) + int(np.searchsorted(t, span % length))
        for i in np.flatnonzero(got).tolist():
            s, n = int(now[i]), int(got[i])
            slots = many[i].tolist() if i in many else [int(single[i])]
            out[names[s]].append((int(taken[s]), int(taken[s]) + n, start, int(own[i]), length, slots))
        taken[now] += got
        left[now] -= got
        start += span
    return out


def _ranked(docs: DataFrame, names: Mapping[str, str], source: str, key: str, largest: int) -> DataFrame:
    """``docs`` with its source and its rank, the place within the source by md5 of the key, from 0.

    A source is cut by the first md5 digits into buckets of about `_BUCKET_ROWS` rows, which are
    ranked one by one and continue the counts of the buckets before; no task gets a whole source.
    """
    digits = 0
    while largest > _BUCKET_ROWS * 16**digits:
        digits += 1
    same = [c for c, kind in docs.dtypes if not kind.startswith("map")]
    src, cut, md5, tie, before = (names[c] for c in ("src", "cut", "md5", "tie", "before"))
    rows = docs.withColumns({
        src: F.coalesce(F.col(source).cast("string"), F.lit("")),
        md5: F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")),
        tie: F.xxhash64(*same),
    }).withColumn(cut, F.substring(md5, 1, digits) if digits else F.lit(""))
    counts = rows.groupBy(src, cut).agg(F.count("*").alias("n"))
    counts = counts.select(src, cut, (F.sum("n").over(Window.partitionBy(src).orderBy(cut)) - F.col("n")).alias(before))
    place = F.row_number().over(Window.partitionBy(src, cut).orderBy(md5, key, tie))
    return rows.join(counts, [src, cut]).withColumn(names["rank"], place - 1 + F.col(before)).drop(cut, before, md5, tie)


def mixed(docs: DataFrame, parts: Mapping[str, int] = TARGET_PARTS, source: str = "source", key: str = "doc_id",
          block_rows: int = BLOCK_ROWS, out: str = "mix") -> DataFrame:
    """``docs`` with the struct column ``out``: block, release, deadline, slot, position.

    Every source is cut into blocks of ``block_rows`` rows in the order of md5(key); its last
    block may be shorter. Slots follow the target parts: after any number of slots of a phase, a
    source has got less than one block more or less than its share. When a source has ended,
    the rest go on among themselves, so every row has exactly one place. ``position`` orders
    the rows. A null source counts as the source ``''``, a null key as an empty one. Repeated
    rows get places of their own. An empty table gives no rows. A column ``out`` is replaced, others
    stay, whatever their names. Texts are not looked at. One row for each source reaches the driver.
    """
    spark = docs.sparkSession
    counts = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s")).count().collect()
    sizes = {r["s"]: r["count"] for r in counts}
    plan = phases({s: -(-n // block_rows) for s, n in sizes.items()}, parts)
    names = _free_names(docs)
    rows = _ranked(docs, names, source, key, max(sizes.values(), default=0))
    rows = rows.withColumn(names["block"], F.floor(F.col(names["rank"]) / block_rows))
    if sum(map(len, plan.values())) <= MAX_PAIRS:
        text = json.dumps([{"src": s, "phases": [dict(zip(_PHASE, p)) for p in ps]} for s, ps in sorted(plan.items())])
        schedule = spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<src:string,phases:array<struct<{_PHASE_TYPE}>>>>")))
        schedule = schedule.select(F.col("src").alias(names["src"]), F.col("phases").alias(names["phase"]))
        rows = rows.join(F.broadcast(schedule), names["src"]).withColumn(names["phase"], F.element_at(F.filter(
            names["phase"], lambda p: (p["first"] <= F.col(names["block"])) & (F.col(names["block"]) < p["last"])), 1))
    else:
        pairs = spark.createDataFrame([(s, p) for s, ps in plan.items() for p in ps], f"src string, p struct<{_PHASE_TYPE}>")
        each = staged(pairs, "schedule").select(F.col("src").alias(names["src"]), F.col("p").alias(names["phase"]),
                                               F.explode(F.sequence(F.col("p.first"), F.col("p.last") - 1)).alias(names["block"]))
        rows = rows.join(each, [names["src"], names["block"]])
    p, n = F.col(names["phase"]), F.col(names["block"])
    k = n - p["first"]
    slot: Column = p["start"] + F.floor(k / p["parts"]) * p["length"] + F.get(p["slots"], (k % p["parts"]).cast("int"))
    result = F.struct(
        n.alias("block"),
        (p["start"] + F.floor(k * p["length"] / p["parts"])).alias("release"),
        (p["start"] + F.ceil((k + 1) * p["length"] / p["parts"])).alias("deadline"),
        slot.alias("slot"), (slot * block_rows + F.col(names["rank"]) % block_rows).alias("position"),
    )
    return rows.select(*[c for c in docs.columns if c != out], result.alias(out))


_PHASE = ("first", "last", "start", "parts", "length", "slots")
_PHASE_TYPE = "first:long,last:long,start:long,parts:long,length:long,slots:array<long>"


def _free_names(docs: DataFrame) -> dict[str, str]:
    """Names for the columns that the schedule needs, none of which ``docs`` has."""
    taken, names = {c.lower() for c in docs.columns}, {}
    for name in ("src", "rank", "block", "phase", "md5", "tie", "cut", "before"):
        free = f"_mix_{name}"
        while free in taken:
            free += "_"
        names[name] = free
    return names
