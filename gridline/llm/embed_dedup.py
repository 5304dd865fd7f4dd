"""Embedding near-duplicates: int8 tile products with error bounds, close calls in full precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .graph import components

THRESHOLD = 0.9
#: Vectors in a block; a task compares two blocks. Never fewer blocks than `LEAST_BLOCKS`.
BLOCK_ROWS, LEAST_BLOCKS = 4096, 16
_EXACT_SUM = 1 << 24  # whole numbers up to here are exact in float32


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, error) of unit vectors: ``x`` is codes * scale plus a rest of length ``error`` at most."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x - codes * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return codes, scale, error


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows, by float32 products over so few columns that no sum is rounded."""
    wide = _EXACT_SUM // (127 * 127)
    out = a[:, :wide].astype(np.float32) @ b[:, :wide].astype(np.float32).T
    if a.shape[1] > wide:
        out = out.astype(np.float64)
        for at in range(wide, a.shape[1], wide):
            out += a[:, at:at + wide].astype(np.float32) @ b[:, at:at + wide].astype(np.float32).T
    return out


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit vectors whose product reaches ``threshold``, tile by tile.

    With x = sp + e and y = tq + f, the product differs from st(p.q) by no more than
    |sp||f| + |tq||e| + |e||f|. Only pairs that this bound leaves possible are computed again.
    """
    p, s, e = quantise(x)
    q, t, f = quantise(y)
    reach, most = np.linalg.norm(q * t[:, None], axis=1), f.max(initial=0)
    for at in range(0, len(x), rows):
        part = slice(at, at + rows)
        products = code_products(p[part], q)
        # The tile is first cut by each row's loosest bound, then the few left by their own.
        length = np.linalg.norm(p[part] * s[part, None], axis=1)
        slack = length * most + reach.max(initial=0) * e[part] + e[part] * most + 1e-9
        low = ((threshold - slack) / s[part])[:, None] / t[None, :]
        low -= np.abs(low) * 1e-6
        i, j = np.nonzero(products >= low.astype(np.float32))
        bound = products[i, j].astype(np.float64) * s[part][i] * t[j] + length[i] * f[j] + reach[j] * e[part][i] + e[part][i] * f[j]
        i, j = i[bound >= threshold - 1e-9], j[bound >= threshold - 1e-9]
        real = np.einsum("ij,ij->i", x[part][i], y[j])
        yield i[real >= threshold] + at, j[real >= threshold]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` nodes reaches over the edges (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``vectors``.

    Two rows link if the cosine of their vectors, in double precision, reaches ``threshold``.
    Null and zero vectors and those with a null or non-finite component link with nothing, and
    vectors of different lengths never link. Equal vectors are first collapsed to the smallest
    key, with the count of rows. The rest is dealt into blocks, every pair of blocks is one
    task, and a task returns, for each of its vectors, the links counted and one edge to the
    smallest vector it reaches there; so the result of a task is never larger than its input.
    Repeated rows are copies of each other. A null key is no node: its row has null results.
    An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    size = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v))
    usable = F.coalesce(~F.isnan(size) & (size > 0) & (size < float("inf")) & ~F.array_contains(F.transform("x", F.isnull), True), F.lit(False))
    rows = rows.withColumn("usable", usable & F.col("id").isNotNull())
    good = rows.where("usable")
    same = staged(good.groupBy("x").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "equal-vectors")
    blocks = max(LEAST_BLOCKS, -(-same.count() // block_rows))
    # Blocks of equal size up to chance; a block pairs with itself and, once, with every other block.
    dealt = same.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    tiles = dealt.withColumn("other", other).withColumn(
        "tile", F.least("block", "other") * F.lit(blocks) + F.greatest("block", "other")).drop("other")

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        left = int(tile["tile"].iloc[0]) // blocks
        right = int(tile["tile"].iloc[0]) % blocks
        rep, copies = tile["rep"].to_numpy(np.int64), tile["copies"].to_numpy(np.int64)
        links, ends = np.zeros(len(tile), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for wide, own in tile.groupby(tile["x"].map(len)).indices.items():
            x = np.stack(tile["x"].to_numpy()[own]).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            block = tile["block"].to_numpy()[own]
            a, b = own[block == left], own[block == right]
            for i, j in close_pairs(x[block == left], x[block == right], threshold):
                i, j = a[i], b[j]
                if left == right:
                    i, j = i[i != j], j[i != j]
                    np.add.at(links, i, copies[j])
                else:
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                ends.append((i, j))
        i, j = (np.concatenate(e) for e in zip(*ends))
        order = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), np.int64)
        place[order] = np.arange(len(rep))
        root = rep[order][forest(len(rep), place[i], place[j])][place]
        some = (links > 0) | (root != rep)
        return pd.DataFrame({"rep": rep[some], "links": links[some], "root": root[some]})

    found = tiles.groupBy("tile").applyInPandas(compare, "rep long, links long, root long")
    found = staged(found, "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    whole = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = same.join(counts, "rep", "left").join(whole.withColumnRenamed("node", "rep"), "rep", "left").select(
        "x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(classes, "x").select("id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("id", F.when(F.col("id").isNotNull(), F.lit(0)).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(
        F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
