"""Byte-level BPE ids of whole batches: pieces are cut, told apart and looked up as arrays."""

from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd

_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
#: Pieces remembered by a Python worker, at about 50 bytes each.
_MOST = 3_000_000
_ONE, _TWO = {ord(c) for c in "stmd"}, {(ord(a), ord(b)) for a, b in ("re", "ve", "ll")}


def _classes() -> np.ndarray:
    """Class of every code point as the tokenizer's pattern has them."""
    import regex

    every, kinds = "".join(map(chr, range(sys.maxunicode + 1))), np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for m in regex.finditer(pattern, every):
            kinds[m.start():m.end()] = kind
    return kinds


def _byte_letters() -> np.ndarray:
    """The character that stands for each byte in tokens: itself if it is visible in Latin-1, else the next one from 256 on."""
    visible = [33 <= b < 127 or 161 <= b < 173 or b >= 174 for b in range(256)]
    return np.array([b if v else 256 + visible[:b].count(False) for b, v in enumerate(visible)], "<u2")


def cut_pieces(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """First code point of each piece of several texts, which start at ``first`` (all texts non-empty).

    A piece is a contraction ('s 't 're 've 'm 'll 'd), or a run of letters, of digits or of other
    visible characters, each with one space before it if there is one, or white space, of which the
    last character before something visible stands by itself.
    """
    n = len(points)
    kind = classes[points]
    text = np.zeros(n + 1, bool)
    text[first] = text[n] = True
    run = text.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    blank = points == 32
    white = kind == _SPACE
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1] & ~text[1:n]
    piece = np.zeros(n + 1, bool)
    # Runs start a piece unless a space before them does; the last white space before a visible character always does.
    piece[:n] = run[:n] & (white | ~after_blank)
    piece[:n - 1] |= white[:-1] & ~white[1:] & ~text[1:n]
    # An apostrophe alone, not behind a space, with the letters of a contraction.
    for i in np.flatnonzero((points == 39) & run[:n] & ~after_blank & run[1:]).tolist():
        if i + 1 < n and not text[i + 1] and kind[i + 1] == _LETTER:
            size = 1 if int(points[i + 1]) in _ONE else 2 if i + 2 < n and not text[i + 2] and (int(points[i + 1]), int(points[i + 2])) in _TWO else 0
            if size:
                piece[i + 1] = False
                piece[i + 1 + size] = True
    return np.flatnonzero(piece[:n])


class BytePairs:
    """Coder of a byte-level BPE file.

    Such a tokenizer cuts a text by its pattern and merges within the pieces, so equal pieces have
    equal ids. Pieces are told apart by two 64-bit hashes out of running sums; those not met
    before are encoded by the library, all in one call. Texts with a special token, and pieces
    of more than ``_LONG`` code points, go to the library as they are.
    """

    _LONG = 256

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library, self.merger = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([])  # pieces come cut, in letters for bytes
        self.letters = _byte_letters()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character of a token stands for a byte
        self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.classes = _classes()
        random = np.random.default_rng(20250131)
        self.codes = random.integers(0, 2**64, 1 << 16, dtype=np.uint64) | np.uint64(1)
        self.bases = [int(b) | 1 for b in random.integers(0, 2**63, 2)]
        self.powers = [np.ones(1, np.uint64)] * 2
        self._forget()

    def _forget(self) -> None:
        # Sorted hashes with the slot of each, and for each slot the second hash and its ids.
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.check, self.start, self.count = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))
        self.ids = np.zeros(0, "<u4")

    def _hashes(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Two hashes of each piece: sums of character codes times falling powers of an odd base."""
        out, n = [], len(points)
        code = self.codes[points & 0xFFFF]
        if (high := points >> 16).any():
            code = code + high.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j, base in enumerate(self.bases):
            while len(self.powers[j]) <= n:
                grown = self.powers[j]
                self.powers[j] = np.concatenate([grown, grown * np.uint64(pow(base, len(grown), 2**64))])
            power = self.powers[j]
            # The power falls along the text, so a piece's sum is brought to its own end by a product.
            sums = np.concatenate([[np.uint64(0)], np.cumsum(code * power[n - 1::-1][:n] if n else code)])
            h = (sums[end] - sums[begin]) * power[begin]
            h ^= h >> np.uint64(29)
            out.append(h * np.uint64(0xBF58476D1CE4E5B9) + (end - begin).astype(np.uint64))
        return out

    def _learn(self, pieces: list[str], keys: np.ndarray, checks: np.ndarray) -> None:
        ids = np.array(self.merger.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        # Ids hold no borders between pieces, but both spell out the same bytes.
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(p) for p in pieces]), "left") + 1
        count = np.diff(np.concatenate([[0], ends]))
        order = np.argsort(keys)
        at = np.searchsorted(self.known, keys[order])
        self.known = np.insert(self.known, at, keys[order])
        self.slot = np.insert(self.slot, at, (len(self.check) + order).astype(np.int32))
        self.check = np.concatenate([self.check, checks])
        self.start = np.concatenate([self.start, len(self.ids) + ends - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids])

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text; ``data`` are the bytes of all, text i is ``offsets[i]:offsets[i + 1]``."""
        out = [np.zeros(0, "<u4")] * (len(offsets) - 1)
        if not len(data):
            return out
        whole = data.tobytes().decode()
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # of each text, in code points
        rows = np.flatnonzero(np.diff(place))
        first = place[rows]
        begin = cut_pieces(points, first, self.classes)
        end = np.append(begin[1:], len(points))
        hashed, check = self._hashes(points, begin, end)
        code, keys = pd.factorize(hashed)
        if len(self.known) + len(keys) > _MOST:
            self._forget()
        new = np.ones(len(keys), bool)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
            new = self.known[at] != keys
        if new.any():
            sample = np.flatnonzero(np.concatenate([[True], code[1:] > np.maximum.accumulate(code)[:-1]]))[new]
            byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where each code point starts
            spelled = self.letters[data].tobytes().decode("utf-16-le")
            cut = zip(byte[begin[sample]].tolist(), byte[end[sample]].tolist())
            self._learn([spelled[x:y] for x, y in cut], keys[new], check[sample])
        slot = self.slot[np.searchsorted(self.known, keys)][code]
        count = self.count[slot]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.start[slot] - total[:-1], count) + np.arange(total[-1])]
        of_text = total[np.searchsorted(begin, np.append(first, len(points)))]
        for r, a, b in zip(rows.tolist(), of_text[:-1].tolist(), of_text[1:].tolist()):
            out[r] = ids[a:b]
        # Texts that go to the library as they are.
        odd = (self.check[slot] != check) | (end - begin > self._LONG)
        again = set(rows[np.searchsorted(first, begin[odd], "right") - 1].tolist())
        for s in self.special:
            at = whole.find(s)
            while at >= 0:
                again.add(int(rows[np.searchsorted(first, at, "right") - 1]))
                at = whole.find(s, at + 1)
        for r in again:
            out[r] = self._whole(whole[place[r]:place[r + 1]])
        return out

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        data = [t.encode() for t in texts]
        return self.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64))


_CODERS: dict[str, BytePairs] = {}


def coder(path: str) -> BytePairs:
    """The coder of a file, one for each Python worker."""
    if path not in _CODERS:
        _CODERS[path] = BytePairs(path)
    return _CODERS[path]
