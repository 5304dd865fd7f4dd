"""FM-index over word ids: backward search through a wavelet matrix, for many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with the count of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        words = np.packbits(bits, bitorder="little")
        words = np.pad(words, (0, -len(words) % 8 + 8)).view("<u8")
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, off = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << off) - np.uint64(1)))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` ids at least, by doubling the compared length."""
    rank, compared = text.astype(np.int64), 1
    while True:
        if compared >= depth:
            return np.argsort(rank, kind="stable")
        ahead = np.zeros(len(rank), np.int64)
        ahead[:max(0, len(rank) - compared)] = rank[compared:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + ahead
        order = np.argsort(key, kind="stable")
        step = np.empty(len(key), np.int64)
        step[0:1] = 0
        step[1:] = np.cumsum(key[order][1:] != key[order][:-1])
        rank = np.empty(len(key), np.int64)
        rank[order] = step
        compared *= 2


class FMIndex:
    """Index of sequences of ids from 1 up; 0 ends each sequence. Finds patterns of up to ``depth - 1`` ids."""

    def __init__(self, sequences: np.ndarray, ends: np.ndarray, depth: int):
        """``sequences`` are all ids one after another, ``ends`` the place after the last of each."""
        text = np.insert(sequences, ends, 0)
        self.order = suffix_order(text, depth)
        self.sequence = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])) + 1)
        last = text[self.order - 1]
        symbols = int(text.max(initial=0)) + 1
        self.levels, self.zeros, row = [], [], last
        starts = np.zeros(symbols, np.int64)
        every = np.arange(symbols)
        for level in reversed(range(max(1, (symbols - 1).bit_length()))):
            bit = (row >> level & 1).astype(bool)
            bits, zeros = Bits(bit), int(len(bit) - bit.sum())
            ones = bits.rank(starts)
            starts = np.where(every >> level & 1, zeros + ones, starts - ones)
            self.levels.append((level, bits))
            self.zeros.append(zeros)
            row = np.concatenate([row[~bit], row[bit]])
        smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))[:-1]])
        self.shift = smaller - starts  # from the end of the wavelet matrix back to the suffix order

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of ``symbol`` followed by what the interval stands for."""
        at, symbol = np.concatenate([low, high]), np.concatenate([symbol, symbol])
        for (level, bits), zeros in zip(self.levels, self.zeros):
            ones = bits.rank(at)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        at = at + self.shift[symbol]
        return at[:len(low)], at[len(low):]

    def intervals(self, text: np.ndarray, begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with ``text[b:b + length]``, for each b of ``begins``."""
        low, high = np.zeros(len(begins), np.int64), np.full(len(begins), len(self.order), np.int64)
        for k in reversed(range(length)):
            low, high = self.step(low, high, text[begins + k])
        return low, high
