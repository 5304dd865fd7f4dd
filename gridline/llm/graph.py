"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that can be reached.

    Alternates two contractions until nothing changes: every node hangs its larger
    neighbours onto the smallest node it sees, then its smaller neighbours. The number of
    rounds grows with the logarithm of the longest chain. Each round is a written table, so
    a lost executor costs one round. A hub is a group of a partial aggregate and a key of a
    join that can be split. Loops and repeated edges are allowed; no edges give no rows.
    """
    def by_node(e: DataFrame) -> DataFrame:
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        return e.join(low, "u").withColumn("m", F.least("u", "m"))

    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = staged(edges, "edges")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = by_node(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = by_node(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = staged(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
