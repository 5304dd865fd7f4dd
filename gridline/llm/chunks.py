"""Tokenizing by parts of texts with a bounded memory of parts seen before."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

# White space of any kind besides space and line feed: such texts take the careful way.
_OTHER = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")


def cut(text: str) -> list[str]:
    """``text`` cut at single spaces that stand between two visible characters; ' '.join undoes it."""
    parts = text.split(" ")
    if "  " not in text and "\n " not in text and " \n" not in text and parts[0] and parts[-1] and not _OTHER.search(text):
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        last = out[-1]
        if p and last and not p[0].isspace() and not last[-1].isspace() and not _OTHER.match(p[0]) and not _OTHER.match(last[-1]):
            out.append(p)
        else:
            out[-1] = f"{last} {p}"
    return out


class PartCoder:
    """Ids of texts, put together from the ids of their parts.

    ``cut`` takes a text apart, ``encode`` gives the little-endian 32-bit ids of each part. Right
    where the tokenizer's own tokens never reach over the cuts. The memory of parts seen before
    is emptied at ``most`` parts.
    """

    def __init__(self, cut: Callable[[str], list[str]], encode: Callable[[list[str]], list[bytes]], most: int = 700_000):
        self.cut, self.encode, self.most = cut, encode, most
        self.seen: dict[str, bytes] = {}

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        cuts, parts = [self.cut(t) for t in texts], set()
        for c in cuts:
            parts.update(c)
        new = list(parts - self.seen.keys())
        if len(self.seen) + len(new) > self.most:
            self.seen.clear()
            new = list(parts)
        if new:
            self.seen.update(zip(new, self.encode(new)))
        ids = self.seen.__getitem__
        return [np.frombuffer(b"".join(map(ids, c)), "<u4") for c in cuts]


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()
