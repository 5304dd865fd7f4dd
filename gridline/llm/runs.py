"""Runs of repeated words: Lyndon words by the grouping phase of a suffix sorter, extended into maximal repetitions."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import Flat, slices

#: A run has at least so many words and so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
_GRAM = 5  # every run has two equal grams of so many words, one period apart


def lyndon_lengths(ranks: Sequence[int]) -> list[int]:
    """For each place, the length of the longest Lyndon word that starts there.

    Phase one of the grouping suffix sorter: places are grouped by their first rank, and groups
    are taken from the highest down. A place of the taken group is the start of its Lyndon word
    for good and goes, by appending that word, to the nearest place on its left that is left
    over. Places that got the word k times leave their group for a new one right above it, in
    order of k. Every place is taken once and passes its word on once, so the work is linear.
    """
    n = len(ranks)
    size, left, right = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
    members: list[list[int]] = [[] for _ in set(ranks)]
    number = {r: g for g, r in enumerate(sorted(set(ranks)))}
    group = [number[r] for r in ranks]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(members) - 1))  # the next lower group; only the highest one left is ever taken
    above = list(range(1, len(members) + 1))
    top = len(members) - 1
    while top >= 0:
        grown: dict[tuple[int, int], list[int]] = {}
        word, owner, times = 0, -1, 0
        for i in members[top]:
            if group[i] != top:
                continue
            word, p, q = size[i], left[i], right[i]
            if q < n:
                left[q] = p
            if p < 0:
                continue
            right[p] = q
            if p == owner:
                times += 1
            else:
                if times:
                    grown.setdefault((group[owner], times), []).append(owner)
                owner, times = p, 1
        if times:
            grown.setdefault((group[owner], times), []).append(owner)
        members[top] = []
        for old, k in sorted(grown, key=lambda g: -g[1]):
            new, after = len(members), above[old]
            members.append(grown[old, k])
            below.append(old)
            above.append(after)
            above[old] = new
            if after < len(below):
                below[after] = new
            for p in members[new]:
                group[p] = new
                size[p] += k * word
        top = below[top]
    return size


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """Elements on which two arrays agree from the front, looking at ever longer stretches."""
    at, step, n = 0, 16, min(len(x), len(y))
    while at < n:
        differ = np.flatnonzero(x[at:min(at + step, n)] != y[at:min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def _runs_from(words: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int, int]]:
    """Runs of ``words`` that have at least three whole periods inside ``a:b``."""
    ranks = words[a:b].tolist()
    for order in (ranks, [-r for r in ranks]):
        size = np.array(lyndon_lengths(order), np.int64)
        # A Lyndon word that stands there three times in a row; a run is extended from the first of them.
        last = np.arange(len(size)) + 2 * size
        ok = last < len(size)
        ok[ok] = (size[last[ok] - size[ok]] == size[ok]) & (size[last[ok]] == size[ok])
        known: dict[int, int] = {}
        for i in np.flatnonzero(ok).tolist():
            q, i = int(size[i]), a + i
            if i + q <= known.get(q, 0):
                continue
            end = i + q + _agree(words[i:], words[i + q:])
            start = i - _agree(words[:i][::-1], words[:i + q][::-1])
            known[q] = end
            yield start, end - start, q


def find_runs(words: np.ndarray, stretches: Sequence[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period.

    ``words`` are numbers that are equal where words are. ``stretches`` are parts that hold every
    run, up to their neighbours; by default the whole is one.
    """
    found = {r for a, b in (stretches if stretches is not None else [(0, len(words))]) for r in _runs_from(words, a, b)}
    return sorted(r for r in found if r[1] >= max(MIN_WORDS, MIN_PERIODS * r[2]))


def stretches(flat: Flat) -> list[list[tuple[int, int]]]:
    """For each text the parts in which runs can lie.

    In a run of period q every word but the last q + 4 starts five words that occur again within q
    words, and it has more than three times q of those. So runs begin in stretches of such words
    and end within a third of the stretch behind it.
    """
    n, grams = len(flat.first) - 1, flat.grams(_GRAM)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    text = np.searchsorted(flat.first, np.arange(len(grams)), "right") - 1
    inside = np.arange(len(grams)) + _GRAM <= flat.first[text + 1]
    order = np.flatnonzero(inside)
    order = order[np.lexsort((grams[order], text[order]))]
    again = np.zeros(len(grams) + 1, bool)
    again[order[:-1]] = (grams[order[1:]] == grams[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    edge = np.diff(np.concatenate([[0], again.astype(np.int8)]))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        # Two texts are never one stretch: the last words of a text start no five words.
        t = int(text[a])
        first = int(flat.first[t])
        out[t].append((a - first, min(b + (b - a + _GRAM - 1) // (MIN_PERIODS - 1) + _GRAM, int(flat.first[t + 1])) - first))
    return out


@dataclass
class Collapsed:
    runs: list[tuple[int, int, int]]
    text: bytes


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words joined by one space, without those behind the first period of a run."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)])


def _numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def planted(words: list[bytes], key: int | None) -> list[bytes]:
    """``words`` with a periodic end in every tenth document, as the key's checksum says."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * -(-(n - a) // p))[:n - a]


def collapsed(texts: pa.Array, keys: list[int | None], change: Callable[[list[bytes], int | None], list[bytes]] | None) -> Iterator[Collapsed]:
    """Runs of each text and the text without their repeats, a few megabytes of texts at a time."""
    for row, n, data, offsets in slices(texts):
        raw = data.tobytes()
        split = [raw[a:b].split() for a, b in zip(offsets[:-1], offsets[1:])]
        if change:
            split = [change(w, k) for w, k in zip(split, keys[row:row + n])]
        joined = [b" ".join(w) for w in split]
        ends = np.concatenate([[0], np.cumsum([len(j) for j in joined])]).astype(np.int64)
        for words, own, where in zip(split, joined, stretches(Flat(np.frombuffer(b"".join(joined), np.uint8), ends))):
            runs = find_runs(_numbers(words), where) if where else []
            yield Collapsed(runs, collapse(words, runs) if runs else own)


_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", out: str = "runs", digest: bool = False,
                  change: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """``docs`` with the struct ``out``: runs (start, length, period; by start, then period) and collapsed.

    Words are runs of other characters than ASCII white space, numbered from 0. ``collapsed`` has
    the words that are in no run, or among the first period of every run they are in, joined by
    one space; ``digest=True`` gives its SHA-256 in hexadecimal instead. ``change`` may replace
    the words of a document by its words and its ``key`` (a whole number) first.

    Two Lyndon words of equal runs are one run, and ties can't occur: (start, period) is unique. A
    null or blank text has no words and no runs. Whole texts are searched, with memory for the
    longest one. Repeated rows agree, an empty table gives no rows, null keys are passed on as
    such. Other columns stay; a column named ``out`` is replaced.
    """
    @F.arrow_udf(f"struct<runs:{_RUNS},collapsed:string>")
    def found(texts: pa.Array, keys: pa.Array) -> pa.Array:
        runs, left = [], []
        for c in collapsed(texts, keys.to_pylist(), change):
            runs.append([dict(zip(("start", "length", "period"), r)) for r in c.runs])
            left.append(hashlib.sha256(c.text).hexdigest() if digest else c.text.decode())
        return pa.StructArray.from_arrays([pa.array(runs, pa.list_(_RUN)), pa.array(left, pa.string())], ["runs", "collapsed"])

    return docs.withColumn(out, found(F.col(text), F.col(key).cast("long")))
