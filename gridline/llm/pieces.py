"""SentencePiece encoding that keeps the place of every piece in the source, and decoding."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import PartCoder, cut, packed
from .texts import slices

_MARK = "▁"


class CharacterMap:
    """Longest-prefix normalisation through a compiled character map.

    The map is a double-array trie over source bytes (32-bit units: label, leaf flag, offset
    to the children, or a value) and a pool of replacements, each ended by a zero byte.
    """

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.pool = compiled[4 + size:] if compiled else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes, replacement) of the longest entry at ``at``."""
        if not self.units:
            return None
        found, node = None, 0
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[i]:
                break
            unit = self.units[node]
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                value = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.pool[value:self.pool.index(0, value)]
        return found

    def starts(self) -> np.ndarray:
        """Which bytes an entry of the map can begin with."""
        first = np.zeros(256, bool)
        if self.units:
            unit = self.units[0]
            root = (unit >> 10) << ((unit & 0x200) >> 6)
            for b in range(1, 256):
                first[b] = root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b
        return first

    def align(self, data: np.ndarray, offsets: np.ndarray, escape: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of all normalised texts the source byte (of its text) it came from, and where each text begins.

        As `normalise` without ``dummy`` and ``squeeze``, for whole batches: a source byte becomes as
        many bytes as its replacement has, in whose alignment it stands; only bytes with which an
        entry of the map can begin are looked up one by one.
        """
        mark = len(_MARK.encode()) if escape else 1
        width = np.where(data == 32, mark, 1)
        if self.units:
            raw, done = data.tobytes(), 0
            at = np.flatnonzero(self.starts()[data])
            ends = offsets[np.searchsorted(offsets, at, "right")]
            for i, end in zip(at.tolist(), ends.tolist()):
                if i >= done and (found := self.longest(raw[i:end], 0)):
                    width[i:i + found[0]] = 0
                    width[i] = len(found[1]) + (mark - 1) * found[1].count(b" ")
                    done = i + found[0]
        size = np.concatenate([[0], np.cumsum(width)])[offsets]
        own = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
        return np.repeat(own, width), size

    def normalise(self, data: bytes, dummy: bool = False, squeeze: bool = False, escape: bool = False) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them, and for the end, the source byte that it came from.

        ``dummy`` puts a space before the text, ``squeeze`` leaves out spaces at both ends and
        after another space, ``escape`` writes spaces as the mark that pieces carry.
        """
        space, out, source, at = _MARK.encode() if escape else b" ", bytearray(), [], 0
        spaced, started = squeeze, not dummy
        while at < len(data):
            n, new = self.longest(data, at) or (0, b"")
            copied = not n
            if copied:
                lead = data[at]
                n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = data[at:at + n]
            if spaced and squeeze:
                new = new.lstrip(b" ")
            if new:
                if not started:
                    out += space
                    source += [at] * len(space)
                    started = True
                spaced = new.endswith(b" ")
                new = new.replace(b" ", space)
                out += new
                # Bytes of a character that is copied are their own source, those of a replacement its first one.
                source += range(at, at + n) if copied and data[at] != 32 else [at] * len(new)
            at += n
        end = at
        if squeeze:
            while out.endswith(space):
                end = source[len(out) - len(space)]
                del out[-len(space):]
        return bytes(out), np.array([*source[:len(out)], end], np.int64)


@dataclass
class Encoded:
    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    text: str


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.map, self.dummy, self.squeeze = (
            CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        self.end_id = self.library.eos_id()
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        # Normalised bytes of each piece: a byte piece has one, a control piece none.
        self.width = np.array([0 if self.library.is_control(i) else 1 if self.library.is_byte(i) else
                               len(p.encode()) for i, p in enumerate(pieces)], np.int64)
        self.escape = spec.escape_whitespaces
        self.unknown = self.library.unk_id()
        # Chunks may be encoded apart if no piece reaches over a space between visible characters.
        apart = all(_MARK not in p.lstrip(_MARK) for p in pieces)
        plain = self.dummy and not self.squeeze and not self.map.units and spec.escape_whitespaces
        bytewise = any(self.library.is_byte(i) for i in range(size))
        self.coder = PartCoder(cut, lambda parts: [packed(i) for i in self.library.encode(parts, num_threads=1)], 300_000) \
            if apart and plain and bytewise else None

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids with the end id, as the library gives them."""
        whole = [i for i, t in enumerate(texts) if not self.coder or not t or _MARK in t or "\0" in t]
        out = self.coder.batch(texts) if self.coder else [np.zeros(0, "<u4")] * len(texts)
        for i, ids in zip(whole, self.library.encode([texts[i] for i in whole], num_threads=1) if whole else []):
            out[i] = np.array(ids, "<u4")
        return [np.append(ids, np.uint32(self.end_id)) for ids in out]

    def spans(self, texts: list[str], ids: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the first source byte of each piece and the one after its last; a piece without source bytes is empty.

        Every text is normalised with its alignment, and the borders of its pieces in the
        normalised text are looked up there. That the pieces' bytes add up to the normalised text
        is checked; texts where they don't (unknown pieces) are taken piece by piece.
        """
        data = [t.encode() for t in texts]
        if self.squeeze:
            return [self._span(t, d, i) for t, d, i in zip(texts, data, ids)]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        source, begin = self.map.align(np.frombuffer(b"".join(data), np.uint8), offsets, self.escape)
        lead, out = (len(_MARK.encode()) if self.escape else 1) if self.dummy else 0, []
        for t, d, i, a, b in zip(texts, data, ids, begin[:-1].tolist(), begin[1:].tolist()):
            first = lead if b > a else 0  # bytes of the space put before the text
            edge = np.concatenate([[0], np.cumsum(self.width[i])])
            if edge[-1] != first + b - a or (i == self.unknown).any():
                out.append(self._span(t, d, i))
                continue
            # The last place of the alignment is the end of the text.
            place = np.append(source[a:b], len(d))[np.maximum(edge - first, 0)]
            out.append((place[:-1], place[1:]))
        return out

    def _span(self, text: str, data: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        normal, source = self.map.normalise(data, self.dummy, self.squeeze, self.escape)
        pieces = self.library.encode(text, out_type=str) if normal else []
        width = [1 if self.library.is_byte(int(i)) else len(p.encode()) for p, i in zip(pieces, ids)]
        edge = np.concatenate([[0], np.cumsum(width), [len(normal)] * (len(ids) - len(width))]).astype(np.int64)
        return source[edge[:-1]], source[edge[1:]]

    def encode(self, texts: list[str]) -> list[Encoded]:
        ids = self.ids(texts)
        decoded = self.library.decode([i.tolist() for i in ids], num_threads=1)
        return [Encoded(i, *s, d) for i, s, d in zip(ids, self.spans(texts, ids), decoded)]


_MODELS: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """The model at ``path``, loaded once for each Python worker."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


_FULL = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("begin", pa.list_(pa.int64())),
                   ("end", pa.list_(pa.int64())), ("decoded", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                     ("decoded_sha256", pa.string()), ("covered_bytes", pa.int64())])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _full(key: int, e: Encoded) -> tuple:
    return key, e.ids.tolist(), e.begin.tolist(), e.end.tolist(), e.text


def _digest(key: int, e: Encoded) -> tuple:
    return key, len(e.ids), _sha(" ".join(map(str, e.ids.tolist()))), _sha(e.text), int((e.end - e.begin).sum())


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, ids, begin, end, decoded) of every document; ``begin`` and ``end`` are source bytes of each piece.

    ``digest=True`` gives (doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes) of the
    same results instead, computed where the ids are. ``ids`` end with the end id, which covers
    no bytes. A null text is empty and has the end id only. Rows are encoded one by one, whole,
    a few megabytes at a time; repeated rows agree, an empty table gives no rows, other columns
    are not read.
    """
    kind, row = (_DIGEST, _digest) if digest else (_FULL, _full)
    names = {pa.int64(): "bigint", pa.string(): "string", pa.list_(pa.int64()): "array<bigint>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for at, n, _, _ in slices(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(at, n).to_pylist()]
                rows = [row(k, e) for k, e in zip(batch.column(0).slice(at, n).to_pylist(), own.encode(texts))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

    return docs.select(docs[key].cast("long"), docs[text]).mapInArrow(run, ", ".join(f"{f.name} {names[f.type]}" for f in kind))
