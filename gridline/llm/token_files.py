"""Token ids in binary files: byte or bit planes of fixed-size blocks, compressed, with a chunk index."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytepairs import coder
from .texts import slices

MAGIC = b"GLTOK1\0\0"
BLOCK_IDS = 1 << 16
#: A segment is closed after the document with which it reaches this many ids.
SEGMENT_IDS = 1 << 20
_HEAD = struct.Struct("<8sQIIB3x")


def pack(ids: np.ndarray, bits: bool = False, block_ids: int = BLOCK_IDS, level: int = 3) -> bytes:
    """``ids`` (unsigned 32 bit) in the file format.

    Head (magic, ids, ids in a block, blocks, 1 for bit planes), then the chunk index with the
    compressed length of each plane of each block, then the planes. Plane p of a block holds
    byte (or bit) p of each of its ids, so that the nearly constant high planes shrink to nothing.
    """
    planes, size, data, write = 32 if bits else 4, [], [], zstandard.ZstdCompressor(level=level).compress
    for at in range(0, len(ids), block_ids):
        block = np.ascontiguousarray(ids[at:at + block_ids], "<u4")
        rows = block.view(np.uint8).reshape(-1, 4)
        rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1) if bits else np.ascontiguousarray(rows.T)
        data += [write(p.tobytes()) for p in rows]
    size = np.array([len(d) for d in data], "<u4")
    return _HEAD.pack(MAGIC, len(ids), block_ids, len(data) // planes, bits) + size.tobytes() + b"".join(data)


def unpack(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start:stop`` of a packed payload; only the blocks that hold them are decompressed."""
    magic, n, block_ids, blocks, bits = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token payload")
    planes, stop, read = 32 if bits else 4, n if stop is None else min(stop, n), zstandard.ZstdDecompressor().decompress
    size = np.frombuffer(payload, "<u4", blocks * planes, _HEAD.size).astype(np.int64)
    place = _HEAD.size + 4 * len(size) + np.concatenate([[0], np.cumsum(size)])
    out = [np.zeros(0, "<u4")]
    for b in range(start // block_ids, -(-stop // block_ids) if stop > start else 0):
        m = min(block_ids, n - b * block_ids)
        rows = [np.frombuffer(read(payload[place[p]:place[p + 1]]), np.uint8) for p in range(b * planes, (b + 1) * planes)]
        rows = np.stack(rows)
        if bits:
            rows = np.packbits(np.unpackbits(rows, axis=1, count=m).T, axis=1, bitorder="little")
        else:
            rows = np.ascontiguousarray(rows.T)
        out.append(rows.reshape(-1).view("<u4"))
    return np.concatenate(out)[start - start // block_ids * block_ids:][:max(0, stop - start)]


_SEGMENT = "shard int, segment int, first long, n_ids long, docs array<bigint>, lengths array<bigint>, payload binary"
_TYPES = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                    ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text",
                 bits: bool = False) -> None:
    """Encode ``docs`` and write them below ``path`` in ascending order of ``key``.

    Documents are dealt out by ranges of the key, one shard for each task, and each shard is a
    run of segments of whole documents in the format of `pack`, carried by Spark's own file
    commit, so that a lost task leaves nothing behind. Null and empty texts have the end id only,
    null keys come first, repeated rows all stay, an empty table gives an empty folder.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        code, end = coder(tokenizer), np.array([end_id], "<u4")
        held, keys, waiting = [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([x for d in held for x in (d, end)])
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "segment": segment, "first": first, "n_ids": len(ids), "docs": keys,
                "lengths": [len(d) + 1 for d in held], "payload": pack(ids, bits)}], schema=_TYPES)

        for batch in batches:
            ids_of = batch.column(0)
            for at, n, data, offsets in slices(batch.column(1)):
                for k, d in zip(ids_of.slice(at, n).to_pylist(), code.encode(data, offsets)):
                    held.append(d)
                    keys.append(k)
                    waiting += len(d) + 1
                    if waiting >= SEGMENT_IDS:
                        yield close()
                        segment, first, held, keys, waiting = segment + 1, first + waiting, [], [], 0
        if held:
            yield close()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    rows.repartitionByRange("k").sortWithinPartitions("k", "t").mapInArrow(encode, _SEGMENT).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document below ``path``; ``ids=False`` leaves the ids out.

    ``start`` counts the ids of all documents before. Only the totals of the shards, one row
    each, are put in order to find where each shard begins.
    """
    fields = "doc_id long, shard int, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in ("shard", "first", "docs", "lengths", "payload")}
                every, size = unpack(r["payload"]), np.array(r["lengths"], np.int64)
                at = np.concatenate([[0], np.cumsum(size)])
                own = [every[a:b] for a, b in zip(at[:-1], at[1:])]
                columns = [pa.array(r["docs"], pa.int64()), pa.array([r["shard"]] * len(own), pa.int32()),
                           pa.array(at[:-1] + r["first"]), pa.array(size),
                           pa.array([zlib.crc32(o.tobytes()) for o in own], pa.int64())]
                names = ["doc_id", "shard", "start", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(every, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, [*names, "ids"] if ids else names)

    segments = spark.read.schema(_SEGMENT).parquet(path)
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    begins = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("begin"))
    rows = segments.mapInArrow(decode, fields)
    return rows.join(F.broadcast(begins), "shard").withColumn("start", F.col("start") + F.col("begin")).drop("shard", "begin")
