"""Words and their hashes for whole Arrow batches, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

# Bytes that separate words: space and 0x09 to 0x0D. No byte of a multi-byte character is among them.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Separators for word runs of ASCII letters, digits and non-ASCII characters only.
PUNCTUATION = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
PLAIN = np.arange(256, dtype=np.uint8)
#: A-Z become a-z, every other byte stays.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

_CODES = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_STEP, _GRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOOPED = 40  # bytes of a word hashed column by column; longer words are hashed one by one


def mixed(h: np.ndarray) -> np.ndarray:
    """Final mixing of a 64-bit hash, so that every bit depends on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Flat:
    """Words of several texts: byte ranges, hashes, and the first word of each text (``first[i]:first[i+1]``)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE, fold: np.ndarray = PLAIN):
        self.data, self.offsets = data, offsets
        word = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins, ends = word.copy(), word
        if len(data):
            begins[1:] &= ~word[:-1] | edge[1:-1]
            ends = word & np.append(~word[1:] | edge[1:-1], True)
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.begin, offsets)
        self.hash = self._hashes(fold)

    def _hashes(self, fold: np.ndarray) -> np.ndarray:
        size = self.end - self.begin
        h = np.zeros(len(size), np.uint64)
        live = np.flatnonzero(size <= _LOOPED)
        codes = _CODES[fold]
        for j in range(_LOOPED):
            live = live[size[live] > j]
            if not len(live):
                break
            h[live] = (h[live] + codes[self.data[self.begin[live] + j]]) * _STEP
        for i in np.flatnonzero(size > _LOOPED):
            h[i] = xxhash.xxh64_intdigest(fold[self.data[self.begin[i]:self.end[i]]].tobytes())
        return mixed(h + size.astype(np.uint64))

    def prefixes(self, k: int, fold: np.ndarray = PLAIN) -> np.ndarray:
        """Hash of the first ``k`` bytes of each word, of another family than the hashes of words."""
        h, codes = np.full(len(self.begin), _GRAM), _CODES[fold]
        for j in range(k):
            live = np.flatnonzero(self.end - self.begin > j)
            h[live] = (h[live] + codes[self.data[self.begin[live] + j]]) * _STEP
        return mixed(h)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on; those that run over the end of a text mean nothing."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        g = np.zeros(n, np.uint64)
        for j in range(k):
            g = (g + self.hash[j:j + n]) * _GRAM
        return mixed(g)


def slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of rows with about ``most`` bytes together; null is empty.

    A single longer text is a run of its own, so memory follows the longest text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, to - row, data[offsets[row]:offsets[to]], offsets[row:to + 1] - offsets[row]
        row = to


def strings(column: pa.Array) -> Iterator[str | None]:
    """Texts of a column as Python strings, a few megabytes of them at a time."""
    for row, n, _, _ in slices(column):
        yield from column.slice(row, n).to_pylist()
