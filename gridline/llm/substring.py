"""Substring dedup: repeated word windows found by FM-indexes of content-routed shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .fmindex import FMIndex
from .texts import Flat, slices

WINDOW, GRAM = 13, 4
#: Words that a shard's index holds on average, and the least number of shards.
SHARD_WORDS, LEAST_SHARDS = 400_000, 96
#: Runs of one anchor above which each window of them is routed by its own words.
HOT_RUNS = 3000


def _runs(flat: Flat, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word in it, windows, anchor) of the maximal runs of windows with the same least gram hash.

    Equal windows have equal anchors wherever they stand, so they can only meet under one.
    """
    least = flat.grams(gram)
    width, most = 1, window - gram + 1
    if len(least) < most:
        return (np.zeros(0, np.int64),) * 4
    while width < most:
        add = min(width, most - width)
        least = np.minimum(least[:-add], least[add:])
        width += add
    # Windows that run over the end of their text are left out.
    own = np.repeat(np.arange(len(flat.first) - 1), np.diff(flat.first))[:len(least)]
    place = np.flatnonzero(np.arange(len(least)) + window <= flat.first[own + 1])
    own, least = own[place], least[place]
    first = np.flatnonzero(np.concatenate([[len(place) > 0], (least[1:] != least[:-1]) | (own[1:] != own[:-1])])[:len(place)])
    return own[first], place[first] - flat.first[own[first]], np.diff(np.append(first, len(place))), least[first].view(np.int64)


def anchors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, v, anchor) of all runs of ``docs`` (id, t); v is a hash of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vs = (batch.column(i).to_numpy() for i in (0, 1))
            for at, _, data, offsets in slices(batch.column(2)):
                text, _, _, anchor = _runs(Flat(data, offsets), window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + text]), pa.array(vs[at + text]), pa.array(anchor)], ["id", "v", "anchor"])

    return docs.where("id is not null").select("id", F.xxhash64("t").alias("v"), "t").mapInArrow(run, "id long, v long, anchor long")


def _extract(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, v, start, anchor, words) of the runs with the anchors listed for each text; a hot anchor's runs become single windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        for batch in batches:
            for at, n, data, offsets in slices(batch.column(2)):
                text, start, size, anchor = _runs(Flat(data, offsets), window, gram)
                edge, out = np.searchsorted(text, np.arange(n + 1)), []
                for r in range(n):
                    i, v, wanted, hot = (batch.column(c)[at + r] for c in (0, 1, 3, 4))
                    i, v, hot = i.as_py(), v.as_py(), set(hot.as_py())
                    mine = slice(edge[r], edge[r + 1])
                    keep = np.isin(anchor[mine], wanted.values.to_numpy())
                    words = data[offsets[r]:offsets[r + 1]].tobytes().split()
                    for a, m, x in zip(start[mine][keep].tolist(), size[mine][keep].tolist(), anchor[mine][keep].tolist()):
                        if x in hot:
                            out += [(i, v, b, None, b" ".join(words[b:b + window]).decode()) for b in range(a, a + m)]
                        else:
                            out.append((i, v, a, x, b" ".join(words[a:a + m + window - 1]).decode()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "v", "start", "anchor", "words"])

    return rows.mapInArrow(run, "id long, v long, start int, anchor long, words string")


def shard_matches(words: list[str], owners: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each window of each sequence, the smallest owner among the sequences of the shard that hold it.

    The sequences are indexed together, then every window is searched backward, all at once;
    the suffixes of its interval lead to the sequences that hold it.
    """
    split = [w.split(" ") for w in words]
    size = np.array([len(s) for s in split])
    ids = pd.factorize(np.array([w for s in split for w in s], dtype=object))[0].astype(np.int64) + 1
    ends = np.cumsum(size)
    index = FMIndex(ids, ends, window + 1)
    counts = size - window + 1
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    begins = np.arange(counts.sum()) - np.repeat(first, counts) + np.repeat(ends - size, counts)
    low, high = index.intervals(ids, begins, window)
    by_suffix = np.append(owners[index.sequence[index.order]], np.iinfo(np.int64).max)
    distinct, back = np.unique(low, return_inverse=True)
    upper = np.empty(len(distinct), np.int64)
    upper[back] = high
    least = np.minimum.reduceat(by_suffix, np.stack([distinct, upper], axis=1).ravel())[::2]
    return np.split(least[back], np.cumsum(counts)[:-1])


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, found): for each id the (v, starts, copy) of its texts: windows that also start in a text with a smaller id.

    ``docs`` has id and t (text); v is a hash of the text. A copy of a text with a smaller id loses
    every window and goes no further. Anchors that only one text has cannot hold a window that
    others share; the runs of the others are cut out of the texts, equal runs are collapsed to
    their smallest id, and dealt to shards by anchor. Where an anchor is common, its windows are
    dealt by their own words instead, so that no shard follows a hot anchor.
    """
    marked = docs.where("id is not null").select("id", F.xxhash64("t").alias("v"), F.unhex(F.md5(F.col("t").cast("binary"))).alias("same"))
    judged = staged(marked.join(marked.groupBy("same").agg(F.min("id").alias("owner")), "same").select(
        "id", "v", (F.col("owner") < F.col("id")).alias("copy")).distinct(), "copied-texts")
    done = judged.groupBy("id").agg(F.every("copy").alias("copy")).where("copy").select("id")
    runs = anchors(docs, window, gram)
    shared = staged(runs.groupBy("anchor").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n")).where(
        "a <> b").select("anchor", "n"), "shared-anchors")
    meeting = runs.select("id", "anchor").join(shared.select("anchor", F.when(F.col("n") > HOT_RUNS, F.col("anchor")).alias("hot")), "anchor")
    listed = meeting.groupBy("id").agg(F.collect_set("anchor").alias("anchors"), F.collect_set("hot").alias("hot"))
    listed = staged(listed.join(done, "id", "left_anti"), "anchors-of-texts")
    total = (shared.agg(F.sum("n")).first()[0] or 0) * 3 * window // 2
    shards = max(LEAST_SHARDS, -(-total // SHARD_WORDS))
    texts = docs.join(listed, "id").select("id", F.xxhash64("t").alias("v"), "t", "anchors", "hot")
    shard = F.pmod(F.when(F.col("anchor").isNull(), F.xxhash64("words")).otherwise(F.xxhash64("anchor")), F.lit(shards)).cast("int")
    # Runs of other anchors are few for each anchor and go straight to their shard; hot windows are collapsed before.
    cool = _extract(texts.select("id", "v", "t", F.array_except("anchors", "hot").alias("anchors"), F.array().cast("array<long>").alias("hot")), window, gram)
    warm = _extract(texts.where(F.size("hot") > 0).select("id", "v", "t", F.col("hot").alias("anchors"), "hot"), window, gram)
    warm = warm.groupBy("words").agg(F.min("id").alias("owner"), F.lit(None).cast("long").alias("anchor"))
    distinct = cool.select("words", F.col("id").alias("owner"), "anchor").union(warm.select("words", "owner", "anchor")).select(
        "words", "owner", shard.alias("shard"))
    found = _extract(texts, window, gram)

    def match(group: pd.DataFrame) -> pd.DataFrame:
        group = group.groupby("words", sort=False)["owner"].min()
        words = group.index.tolist()
        return pd.DataFrame({"key": [hashlib.md5(w.encode()).digest() for w in words],
                             "least": shard_matches(words, group.to_numpy(np.int64), window)})

    least = distinct.groupBy("shard").applyInPandas(match, "key binary, least array<long>")
    hits = found.select("id", "v", "start", F.unhex(F.md5(F.col("words").cast("binary"))).alias("key")).join(least, "key").select(
        "id", "v", F.array_compact(F.transform("least", lambda m, i: F.when(m < F.col("id"), F.col("start") + i))).alias("starts"))
    hits = hits.where(F.size("starts") > 0).withColumn("copy", F.lit(False)).union(
        judged.where("copy").select("id", "v", F.array().cast("array<long>"), "copy"))
    return hits.groupBy("id").agg(F.collect_list(F.struct("v", "starts", "copy")).alias("found"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): each text without the words of repeated windows.

    Words are runs without ASCII white space. A window is ``window`` words; a word goes if a
    window over it also starts in a text with a smaller key. The kept words are joined by one
    space; ``keep_text=False`` leaves the text itself out. Null and empty texts have no words.
    Repeated rows keep the same words. A row with a null key neither loses nor takes words. An
    empty table gives no rows; other columns are not read. Runs meet by 64-bit anchor hashes,
    which only brings them together: windows match by their words.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    fields = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t, starts, copy in zip(*(c.to_pylist() for c in batch.columns)):
                words = t.encode().split()
                n = len(words)
                if copy and n >= window:
                    words = []
                elif starts:
                    gone = np.zeros(n + 1, np.int64)
                    at = np.unique(np.array(starts))
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:n]) == 0)]
                kept = b" ".join(words)
                out.append((i, n, n - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if keep_text else [])))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["id", "n_words", "n_removed", "kept_sha256", "kept_text"]
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names[:len(columns)])

    joined = rows.join(repeated_windows(rows, window), "id", "left")
    own = F.filter("found", lambda f: f["v"] == F.xxhash64("t"))
    joined = joined.select("id", "t", F.flatten(F.transform(own, lambda f: f["starts"])).alias("starts"),
                           F.exists(own, lambda f: f["copy"]).alias("copy"))
    return joined.mapInArrow(finish, fields).withColumnRenamed("id", key)
