"""N-gram Jaccard join: prefix lists bring sets together, an index with set relations compares them exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .embed_dedup import forest
from .graph import components
from .texts import LOWER, Flat, mixed, slices

#: Sets that one task compares; larger lists and groups are dealt into tiles of half that many.
LIST_ROWS = 256
#: A gram in the prefixes of more sets than this is ordered last, at least; the list of such grams is bounded.
FREQUENT, MOST_FREQUENT = 500, 100_000


def gram_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of each text, A-Z in lower case.

    A text of fewer words has its whole sequence as its one shingle, without words none.
    """
    flat, out = Flat(data, offsets, fold=LOWER), []
    grams = flat.grams(k).view(np.int64)
    for a, b in zip(flat.first[:-1], flat.first[1:]):
        if b - a >= k:
            out.append(np.unique(grams[a:b - k + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in flat.hash[a:b]:
                h = mixed(np.array([h ^ w], np.uint64))[0]
            out.append(np.array([h], np.uint64).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def prefix_length(n: int, percent: int) -> int:
    """Members of a set of ``n`` among which one is shared with every set it links to, in any common order."""
    return n - -(-n * percent // 100) + 1


def _bitmap(grams: np.ndarray, percent: int) -> bytes:
    """Parity of the grams in each of 2^k places: two bitmaps differ in no more places than the sets do.

    Foreign sets differ in about half of the places, so four times the places in which linked
    sets may differ tell them apart.
    """
    width = 128
    while width < 4 * _may_link(len(grams), len(grams), percent):
        width *= 2
    return np.packbits(np.bincount(grams.view(np.uint64) & np.uint64(width - 1), minlength=width).astype(np.uint8) & 1).tobytes()


_FIELDS = {"id": pa.int64(), "n": pa.int64(), "f": pa.int64(), "g": pa.int64(), "prefix": pa.list_(pa.int64()), "bitmap": pa.binary()}


def _sets(docs: DataFrame, k: int, percent: int, frequent: list[int], *columns: str) -> DataFrame:
    """The named ones of (id, n, f, g, prefix, bitmap) of each row of ``docs`` (id, t); f and g tell sets apart."""
    late = np.array(sorted(frequent), np.int64)

    def prefix(s: np.ndarray) -> np.ndarray:
        if len(late) and len(s):
            last = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
            s = np.concatenate([s[~last], s[last]])
        return s[:prefix_length(len(s), percent)] if len(s) else s

    made = {"n": len, "prefix": prefix, "bitmap": lambda s: _bitmap(s, percent),
            "f": lambda s: int(mixed(s.view(np.uint64)).sum().view(np.int64)) if len(s) else 0,
            "g": lambda s: int(np.bitwise_xor.reduce(mixed(~s.view(np.uint64))).view(np.int64)) if len(s) else 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in slices(batch.column(1)):
                sets = gram_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, n) if c == "id" else pa.array([made[c](s) for s in sets], _FIELDS[c]) for c in columns], list(columns))

    kinds = {"prefix": "array<bigint>", "bitmap": "binary"}
    return docs.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in columns))


def _distinct(sets: DataFrame, *carried: str) -> DataFrame:
    """One row for each distinct set that is not empty: its smallest id stands for all of its rows."""
    return sets.where("n > 0 and id is not null").groupBy("n", "f", "g").agg(
        F.min("id").alias("rep"), *[F.first(c).alias(c) for c in carried])


def _tiled(rows: DataFrame, size: str, list_rows: int) -> DataFrame:
    """``rows`` with block and tile: lists above ``list_rows`` are cut into blocks, of which every pair is a tile.

    A row goes to the tiles of its block; a list within the bound is the tile (0, 0).
    """
    blocks = F.when(F.col(size) > list_rows, F.ceil(F.col(size) * 2 / list_rows)).otherwise(F.lit(1)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")


def _stars(rep: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Edges from each of ``rep`` to the smallest it reaches over the pairs (i, j)."""
    nodes, back = np.unique(rep, return_inverse=True)
    root = forest(len(nodes), back[i], back[j])
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], ["a", "b"])


def _may_link(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Most places in which sets of ``n`` and ``m`` grams may differ and still link."""
    return (n + m) * (100 - percent) // (100 + percent)


def _by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups out of sorted batches, several at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        rows = batch.to_pandas()
        if not len(rows):
            continue
        last = (rows[keys] != rows[keys].iloc[-1]).any(axis=1).to_numpy()
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut or (held and (held[-1][keys].iloc[-1] != rows[keys].iloc[0]).any()):
            yield pd.concat([*held, rows.iloc[:cut]], ignore_index=True)
            held = []
        held.append(rows.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _candidates(entries: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that span the groups of sets that may link, from entries sorted by list and tile."""
    keys = ["gram", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches, keys):
            code = np.concatenate([[0], np.cumsum((rows[keys].to_numpy()[1:] != rows[keys].to_numpy()[:-1]).any(axis=1))])
            n, pos, rep, block = (rows[c].to_numpy(np.int64) for c in ("n", "pos", "rep", "block"))
            cross = (rows["low"] != rows["high"]).to_numpy()
            own = rows["bitmap"].map(lambda b: len(b) * 8).to_numpy()
            bits = rows["bitmap"].tolist()
            folded: dict[tuple[int, int], np.ndarray] = {}

            def fold(at: int, width: int) -> np.ndarray:
                if (at, width) not in folded:
                    folded[at, width] = np.bitwise_xor.reduce(np.frombuffer(bits[at], "<u8").reshape(-1, width // 64), axis=0)
                return folded[at, width]

            pairs = []
            for d in range(1, int(np.bincount(code).max())):
                i = np.flatnonzero(code[d:] == code[:-d])
                j = i + d
                least, most = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                # The greatest overlap that is left at the first gram that both share, and the least needed.
                left = 1 + np.minimum(n[i] - pos[i], n[j] - pos[j])
                good = (100 * least >= percent * most) & (left * (100 + percent) >= percent * (least + most))
                good &= ~cross[i] | (block[i] != block[j])
                pairs.append((i[good], j[good]))
            i, j = (np.concatenate(p) for p in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
            width, good = np.minimum(own[i], own[j]), np.zeros(len(i), bool)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                # Bit places are the low bits of a gram, so folding a wide bitmap gives the narrow one.
                nodes, back = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
                table = np.stack([fold(x, int(w)) for x in nodes])
                for part in np.array_split(np.arange(len(at)), max(1, len(at) * int(w) // (1 << 26))):
                    x, y = table[back[:len(at)][part]], table[back[len(at):][part]]
                    apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                    good[at[part]] = apart <= _may_link(n[i[at[part]]], n[j[at[part]]], percent)
            yield _stars(rep, i[good], j[good])

    sorted_ = entries.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.select(*keys, "block", "rep", "n", "pos", "bitmap").mapInArrow(run, "a long, b long")


class SetIndex:
    """Sets in order of size with a list of sets for each gram, in blocks that are skipped by position.

    ``read`` counts list members looked at, ``derived`` the answers made out of another set's.
    """

    BLOCK, KEPT = 64, 16

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.sets = [sets[i] for i in self.order]
        self.size, self.percent = np.array([len(s) for s in self.sets], np.int64), percent
        grams = np.concatenate(self.sets)
        by_gram = np.argsort(grams, kind="stable")
        self.grams, number = np.unique(grams[by_gram], return_inverse=True)
        # One run of lists: gram number and place in the order of size, so lists and places both ascend.
        self.members = number * len(self.sets) + np.repeat(np.arange(len(self.sets)), self.size)[by_gram]
        self.heads = self.members[::self.BLOCK]
        self.read = self.derived = 0

    def _seek(self, keys: np.ndarray) -> np.ndarray:
        """Place of the first member not below each key: its block by the heads of blocks, then a search in the block."""
        block = np.maximum(np.searchsorted(self.heads, keys, "left") - 1, 0)
        low, high = block * self.BLOCK, np.minimum((block + 1) * self.BLOCK, len(self.members))
        while (low < high).any():
            middle = (low + high) // 2
            less = (low < high) & (self.members[np.minimum(middle, len(self.members) - 1)] < keys)
            high = np.where((low < high) & ~less, middle, high)
            low = np.where(less, middle + 1, low)
        return low

    def counts(self, grams: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many of ``grams`` each set from ``low`` to ``high`` holds; the rest of each list is skipped."""
        at = np.searchsorted(self.grams, grams) * len(self.sets)
        begin = self._seek(at + low)
        size = self._seek(at + high) - begin
        self.read += int(size.sum())
        place = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.members[place] % len(self.sets) - low, minlength=max(0, high - low))

    def links(self) -> Iterator[tuple[int, np.ndarray]]:
        """(set, sets that link with it): computed from the lists, or from the answers of a similar set.

        Sets that fit a set in size are one stretch of places. Of the last answers the one whose set
        shares most grams with the asked one, as that answer says, is corrected by the lists of the
        grams in which the two differ, and by those of all grams where the stretch goes on; if they
        differ in more grams than the set has, its own lists are read. Overlaps are exact either way.
        """
        kept: list[tuple[np.ndarray, int, int, np.ndarray]] = []
        for x, own in enumerate(self.sets):
            n = len(own)
            low = int(np.searchsorted(100 * self.size, self.percent * n))
            high = int(np.searchsorted(self.percent * self.size, 100 * n, "right"))
            like = max((k for k in kept if k[1] <= x < k[2]), key=lambda k: k[3][x - k[1]], default=None)
            overlap = None
            if like:
                other, begin, end, known = like
                gone, new = np.setdiff1d(other, own, assume_unique=True), np.setdiff1d(own, other, assume_unique=True)
                if len(gone) + len(new) < n and begin <= low:
                    end = min(end, high)
                    overlap = known[low - begin:end - begin] - self.counts(gone, low, end) + self.counts(new, low, end)
                    overlap = np.concatenate([overlap, self.counts(own, end, high)])
                    self.derived += 1
            if overlap is None:
                overlap = self.counts(own, low, high)
            kept = [*kept[1 - self.KEPT:], (own, low, high, overlap)]
            size = self.size[low:high]
            linked = low + np.flatnonzero(100 * overlap >= self.percent * (size + n - overlap))
            yield self.order[x], np.array([self.order[y] for y in linked if y != x], np.int64)


def _compare(groups: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that span the sets that link, from the whole sets of each tile."""
    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        rep = tile["rep"].to_numpy(np.int64)
        sets = [np.frombuffer(b, "<i8") for b in tile["grams"]]
        ends = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for x, linked in SetIndex(sets, percent).links():
            ends.append((np.full(len(linked), x, np.int64), linked))
        i, j = (np.concatenate(e) for e in zip(*ends))
        return _stars(rep, i, j).to_pandas()

    return groups.groupBy("component", "low", "high").applyInPandas(compare, "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text",
                       list_rows: int = LIST_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Two rows link if 100 times the grams they share is at least ``percent`` times the grams they
    have together; a component is all that links reach, named by its smallest key. Equal sets
    are first collapsed. Sets that share a gram of their prefixes, fit in size and do not differ
    in more places of a bitmap than linked sets may, are candidates; a task returns edges that
    span its candidates, not the pairs. Every group of candidates is then compared exactly on
    whole sets. Long lists and large groups are dealt into tiles. Of gram lists with the same
    members one is kept, so near copies meet once or a few times, however long they are. Grams in many prefixes are
    ordered last, so that common lines and passages don't make long lists.

    Null and empty texts have no grams and link with nothing; a row with a null key has a null
    component. Repeated rows are in one component. An empty table gives no rows, other columns
    are not read. Grams are compared by 64-bit hashes, lists of grams and equal sets by their
    size and 128 bits.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def entries(of: DataFrame) -> DataFrame:
        return of.select("rep", "n", F.posexplode("prefix").alias("pos", "gram"))

    sets = staged(_sets(rows, k, percent, [], "id", "n", "f", "g"), "gram-sets")
    # The first prefixes only tell which grams are frequent: they are counted and not kept.
    lists = _sets(rows, k, percent, [], "prefix").select(F.explode("prefix").alias("gram")).groupBy("gram").count()
    found = lists.where(F.col("count") > FREQUENT).orderBy(F.desc("count"), "gram").limit(MOST_FREQUENT).collect()
    again = _sets(rows, k, percent, [r["gram"] for r in found], "id", "n", "f", "g", "prefix", "bitmap")
    reps = staged(_distinct(again, "prefix", "bitmap"), "distinct-sets")
    # Of lists with the same members, the first in the order of grams does the work of all.
    lists = entries(reps).groupBy("gram").agg(
        F.count("*").alias("size"), F.min("pos").alias("first"), F.bit_xor(F.xxhash64("rep")).alias("members"),
        F.bit_xor(F.xxhash64(F.lit("again"), "rep")).alias("again"))
    shared = lists.where("size > 1").groupBy("size", "members", "again").agg(F.min_by("gram", "first").alias("gram")).select("gram", "size")
    meeting = entries(reps).join(shared, "gram").join(reps.select("rep", "n", "bitmap"), ["rep", "n"])
    maybe = components(_candidates(_tiled(meeting, "size", list_rows), percent))

    groups = maybe.join(maybe.groupBy("component").agg(F.count("*").alias("size")), "component").withColumnRenamed("node", "rep")
    whole = rows.join(groups, rows["id"] == groups["rep"]).select("id", "t", "component", "size")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(2).slice(at, n), batch.column(3).slice(at, n),
                     pa.array([s.tobytes() for s in gram_sets(data, offsets, k)], pa.binary())], ["rep", "component", "size", "grams"])

    full = whole.mapInArrow(grams, "rep long, component long, size long, grams binary").where(F.length("grams") > 0)
    linked = components(_compare(_tiled(full, "size", list_rows), percent))
    classes = reps.select("n", "f", "g", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n", "f", "g", F.coalesce("component", "rep").alias("component"))
    return sets.select("id", "n", "f", "g").join(classes, ["n", "f", "g"], "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
