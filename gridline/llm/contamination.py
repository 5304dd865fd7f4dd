"""Benchmark passages in documents: an Aho-Corasick automaton over the items' words, and one scan of each text."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import LOWER, PUNCTUATION, Flat, slices

WINDOW_WORDS = 10
#: Bytes of item texts behind one automaton (about 100 bytes of memory each); a larger benchmark has several.
SHARD_BYTES = 2 << 20
SLICE_BYTES = 4 << 20
_DIGIT = 6  # bits of a word number in one letter of the automaton


class Windows:
    """Windows of ``k`` consecutive words of each item, or its whole word sequence if that is shorter.

    Holds four bytes for each item word. Words are numbered by their place in the vocabulary; in
    the automaton a number is a fixed count of letters, each digit out of an alphabet of its own,
    so that matches begin and end at words.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], k: int = WINDOW_WORDS):
        data = [(t or "").encode() for _, t in items]
        flat = Flat(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64),
                    PUNCTUATION, LOWER)
        self.k, self.ids, self.first = k, [i for i, _ in items], flat.first.tolist()
        self.hashes, sample, number = np.unique(flat.hash, return_index=True, return_inverse=True)
        self.number = number.astype(np.uint32)
        self.spelling = [LOWER[flat.data[flat.begin[i]:flat.end[i]]].tobytes() for i in sample]
        self.digits = max(1, -(-max(1, len(self.hashes) - 1).bit_length() // _DIGIT))
        sizes = [min(k, b - a) for a, b in zip(self.first, self.first[1:]) if b > a]
        self.shortest = min(sizes, default=0)

    def letters(self, numbers: np.ndarray) -> str:
        shift = np.arange(self.digits, dtype=np.uint32)
        digits = (numbers[:, None] >> (shift * _DIGIT)) & ((1 << _DIGIT) - 1)
        return (digits + (shift << _DIGIT)).astype(np.uint8).tobytes().decode("latin-1")

    def automaton(self) -> ahocorasick.Automaton:
        """Each window's value: its words, and the numbers of the items it occurs in."""
        text, d, found = self.letters(self.number), self.digits, {}
        for item, (a, b) in enumerate(zip(self.first, self.first[1:])):
            n = min(self.k, b - a)
            for j in range(a, b - n + 1) if n else ():
                found.setdefault(text[d * j:d * (j + n)], set()).add(item)
        out = ahocorasick.Automaton()
        for window, items in found.items():
            out.add_word(window, (len(window) // d, tuple(items)))
        if found:
            out.make_automaton()
        return out


class Scanner:
    """Searches texts for the windows of one shard."""

    def __init__(self, windows: Windows):
        self.windows, self.automaton = windows, windows.automaton()

    def hits(self, flat: Flat, covered: np.ndarray, items: dict[int, set[str]]) -> None:
        """Mark in ``covered`` every word inside a window, and add the items to those of the text in ``items``."""
        w = self.windows
        if not w.shortest or not len(flat.hash):
            return
        place = np.minimum(np.searchsorted(w.hashes, flat.hash), len(w.hashes) - 1)
        known = w.hashes[place] == flat.hash
        # Only stretches of known words of one text can hold a window.
        begins, ends = known.copy(), known.copy()
        edge = np.zeros(len(known) + 1, bool)
        edge[flat.first] = True
        begins[1:] &= ~known[:-1] | edge[1:-1]
        ends[:-1] &= ~known[1:] | edge[1:-1]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = ends - begins >= w.shortest
        begins, ends = begins[long], ends[long]
        texts = np.searchsorted(flat.first, begins, "right") - 1
        for a, b, text in zip(begins.tolist(), ends.tolist(), texts.tolist()):
            for end, (n, found) in self.automaton.iter(w.letters(place[a:b].astype(np.uint32))):
                end = a + (end + 1) // w.digits
                if self._same(flat, place, end - n, end):
                    covered[end - n:end] = True
                    items.setdefault(text, set()).update(w.ids[i] for i in found)

    def _same(self, flat: Flat, place: np.ndarray, a: int, b: int) -> bool:
        """Whether the words are spelled as the vocabulary's, which equal hashes only suggest."""
        return all(LOWER[flat.data[flat.begin[i]:flat.end[i]]].tobytes() == self.windows.spelling[place[i]] for i in range(a, b))


_LAST: list = []  # the last scanner of this Python worker, with its shard


def _scanner(shard) -> Scanner:
    if not _LAST or _LAST[0] is not shard:
        _LAST[:] = [shard, Scanner(shard)]
    return _LAST[1]


def _spans(flat: Flat, covered: np.ndarray, at: np.ndarray, a: int, b: int, start: int) -> list[dict[str, int]]:
    """Stretches of covered words ``a:b`` as code points of their text, which starts at byte ``start``."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered[a:b].astype(np.int8), [0]])))
    return [{"start": int(at[flat.begin[a + x]] - at[start]), "end": int(at[flat.end[a + y - 1]] - at[start])}
            for x, y in zip(edges[::2], edges[1::2])]


_TYPE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                   ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         k: int = WINDOW_WORDS, out: str = "benchmark", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with the struct ``out``: n_words, n_hit, items, spans.

    Words are runs of letters, digits and non-ASCII characters, A-Z as a-z. ``n_hit`` counts the
    words inside any occurrence of a window of ``k`` item words; ``items`` are the ids, as sorted
    texts, of items with such a window, ``spans`` the stretches of hit words in the original
    text (code points, end exclusive).

    The benchmark goes to the executors in shards of about ``shard_bytes``, each fetched and
    broadcast by itself; with one shard a worker keeps its automaton, with more it builds them in
    turn for every 32 megabytes of text, so one is in memory at a time. A larger benchmark takes
    longer and loses nothing. Texts go through in runs of some megabytes, a longer one whole.

    A null text or item has no words; an item without an id marks words but is not listed; items
    with one id count once. Repeated rows agree, an empty table gives no rows, an empty benchmark
    no hits. Other columns stay; a column named ``out`` is replaced.
    """
    spark = docs.sparkSession
    wanted = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    size = wanted.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // shard_bytes))
    shards = []
    for s in range(n):
        got = wanted.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == s).toArrow()
        order = sorted(zip(got["i"].to_pylist(), got["t"].to_pylist()), key=lambda r: (r[0] or "", r[1]))
        shards.append(spark.sparkContext.broadcast(Windows(order, k)))

    @F.arrow_udf("struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>")
    def found(texts: pa.Array) -> pa.Array:
        rows = []
        for _, _, data, offsets in slices(texts, SLICE_BYTES * min(n, 8)):
            flat, items = Flat(data, offsets, PUNCTUATION, LOWER), {}
            covered = np.zeros(len(flat.hash), bool)
            for shard in shards:
                _scanner(shard.value).hits(flat, covered, items)
            upto = np.concatenate([[0], np.cumsum(covered)])
            at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if items else None
            for i, (a, b) in enumerate(zip(flat.first[:-1].tolist(), flat.first[1:].tolist())):
                rows.append({"n_words": b - a, "n_hit": int(upto[b] - upto[a]),
                             "items": sorted(x for x in items.get(i, ()) if x is not None),
                             "spans": _spans(flat, covered, at, a, b, int(offsets[i])) if i in items else []})
        return pa.array(rows, _TYPE)

    return docs.withColumn(out, found(F.col(text)))
