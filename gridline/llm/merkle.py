"""Merkle manifest of a table: a tree of digests for each group, a tree over the groups, and a proof for each row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..operators.places import numbered
from ..sources.scratch import staged

ARITY = 2
#: Levels of at most so many nodes are one task's.
ONE_TASK = 20_000


def _no_bytes() -> Column:
    return F.unhex(F.lit(""))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256, in hexadecimal, of the fields as texts: byte count, ``:``, value; ``-`` for null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (g, i, n, digest, ...) with the digests of their siblings, one after the other in one binary.

    A node finds each sibling by an equijoin on its computed index. Children of one node fill up
    from the left, so the siblings before a node are all there.
    """
    slot = F.pmod(F.col("i"), F.lit(arity))
    if arity == 2:
        index = [F.col("i").bitwiseXOR(F.lit(1))]
    else:
        index = [F.col("i") - slot + F.pmod(slot + d, F.lit(arity)) for d in range(1, arity)]
    out = nodes
    for d, at in enumerate(index, 1):
        # Seen from the sibling: the node that has it at this index.
        back = at if arity == 2 else F.col("i") - slot + F.pmod(slot + arity - d, F.lit(arity))
        other = nodes.select("g", back.alias("i"), F.col("digest").alias(f"s{d}"))
        out = out.join(other, ["g", "i"], "left")
    if arity == 2:
        siblings = F.coalesce("s1", _no_bytes())
    else:
        every = F.array(*[f"s{d}" for d in range(1, arity)])
        ordered = F.concat(F.slice(every, arity - F.greatest(slot, F.lit(1)), slot.cast("int")), F.slice(every, 1, (arity - 1 - slot).cast("int")))
        siblings = F.aggregate(F.filter(ordered, lambda s: s.isNotNull()), _no_bytes(), lambda done, s: F.concat(done, s))
    return out.withColumn("siblings", siblings).drop(*[f"s{d}" for d in range(1, arity)])


def _tree(nodes: DataFrame, most: int, total: int, trees: int, arity: int) -> tuple[DataFrame, DataFrame]:
    """Leaves (g, i, n, digest, ...) with ``path``, and (g, root) of each of ``trees`` trees.

    ``most`` is the greatest n and ``total`` the sum of all; a level has at most a part of the total
    and a node more for each tree, and once that is no more than `ONE_TASK` one task does it all.

    Every level is a written table of its nodes with their siblings, out of which the rows in slot
    zero emit the next one; tables shrink by the arity. Paths are handed down from the root, so
    each level takes part in one join.
    """
    def small(level: int) -> bool:
        return total // arity**level + trees <= ONE_TASK

    def written(nodes: DataFrame, level: int) -> DataFrame:
        table = staged(_with_siblings(nodes.coalesce(1) if small(level) else nodes, arity), "merkle-level")
        return table.coalesce(1) if small(level) else table

    levels = [written(nodes, 0)]
    while most > 1:
        emitting = levels[-1].where((F.col("n") > 1) & (F.pmod(F.col("i"), F.lit(arity)) == 0))
        digest = F.unhex(F.sha2(F.concat(_hex(F.col("digest")), _hex(F.col("siblings"))), 256))
        parents = emitting.select("g", F.floor(F.col("i") / arity).alias("i"), F.ceil(F.col("n") / arity).alias("n"), digest.alias("digest"))
        levels.append(written(parents, len(levels)))
        most = -(-most // arity)
    roots = [table.where("n = 1").select("g", F.col("digest").alias("root")) for table in levels]
    none = F.array().cast("array<binary>")
    down = levels[-1].withColumn("path", none)
    for level, table in reversed(list(enumerate(levels[:-1]))):
        if small(level + 1) and not small(level):
            down = staged(down, "merkle-paths")
        above = down.select("g", F.col("i").alias("up"), F.col("path").alias("above"))
        rows = table.withColumn("up", F.floor(F.col("i") / arity)).join(above, ["g", "up"], "left")
        path = F.when(F.col("n") > 1, F.concat(F.array("siblings"), F.coalesce("above", none))).otherwise(none)
        down = rows.withColumn("path", path).drop("up", "above")
    every = roots[0]
    for r in roots[1:]:
        every = every.union(r)
    return down.drop("siblings"), every


def manifest(docs: DataFrame, fields: list[str], key: str = "doc_id", group: str = "lang", arity: int = ARITY,
             carry: Mapping[str, Column] | None = None) -> DataFrame:
    """(key, group, leaf, place, path, subroot, group_place, group_path, root, carry) of every row.

    A row is a leaf with the digest of its ``fields``. In each group leaves ascend by key; every
    ``arity`` consecutive nodes (the last ones: fewer, even one) become the digest of theirs, until
    one is left, the ``subroot``; a lone leaf is one itself. Subroots in the order of their groups
    (null first, then by UTF-8 bytes) likewise become the ``root``. ``path`` and ``group_path`` hold,
    level by level, the digests of the siblings, as bytes one after the other. ``carry`` are
    columns of ``docs`` to keep, in one struct.

    Null fields and keys are allowed, null keys come first. Rows with one key are ordered by their
    digests; repeated rows are leaves of their own. A text counts as a whole, however long. An empty
    table gives no rows. Columns of ``docs`` that are not named are not read, and no name clashes.
    """
    rows = staged(docs.select(
        F.col(key).alias("key"), F.col(group).cast("string").alias("group"),
        F.unhex(leaf_digest([F.col(f) for f in fields])).alias("digest"),
        F.struct(*[c.alias(n) for n, c in (carry or {"key": F.col(key)}).items()]).alias("carry")), "merkle-leaves")
    rows = numbered(rows, ["group", "key", "digest"], "place")
    groups = staged(rows.groupBy("group").agg(F.min("place").alias("first"), F.count("*").alias("n")), "merkle-groups")
    groups = numbered(groups, ["first"], "g")
    most, trees, total = groups.agg(F.max("n"), F.count("*"), F.sum("n")).first()
    leaves = lookup(rows, groups, ["group"], nulls_match=True).withColumn("i", F.col("place") - F.col("first")).drop("first", "place")
    leaves, subroots = _tree(leaves, most or 0, total or 0, trees, arity)
    tops = subroots.select(F.lit(0).alias("g"), F.col("g").alias("i"), F.lit(trees).alias("n"), F.col("root").alias("digest"))
    tops, root = _tree(tops, trees, trees, 1, arity)
    tops = staged(tops.join(F.broadcast(root), "g"), "merkle-roots")  # one row
    tops = tops.select(F.col("i").alias("g"), F.col("digest").alias("subroot"), F.col("path").alias("group_path"), "root")
    out = lookup(leaves, tops, ["g"])
    return out.select("key", "group", _hex(F.col("digest")).alias("leaf"), F.col("i").alias("place"), "path", _hex(F.col("subroot")).alias("subroot"),
                      F.col("g").alias("group_place"), "group_path", _hex(F.col("root")).alias("root"), "carry")


def proof() -> Column:
    """The siblings of a row of `manifest` from its leaf to the root, as one hexadecimal text."""
    return F.lower(F.array_join(F.transform(F.concat("path", "group_path"), F.hex), ""))


def _fold(leaf: Column, place: str, path: str, arity: int) -> Column:
    def step(done: Column, siblings: Column) -> Column:
        slot, others = F.pmod(done["i"], F.lit(arity)).cast("int"), _hex(siblings)
        text = F.concat(F.substr(others, F.lit(1), slot * 64), done["digest"], F.substr(others, slot * 64 + 1))
        return F.struct(F.sha2(text, 256).alias("digest"), F.floor(done["i"] / arity).alias("i"))

    return F.aggregate(path, F.struct(leaf.alias("digest"), F.col(place).cast("long").alias("i")), step)["digest"]


def folded(leaf: Column, arity: int = ARITY) -> Column:
    """The root that ``leaf`` (hexadecimal) has with the siblings of a row of `manifest`."""
    return _fold(_fold(leaf, "place", "path", arity), "group_place", "group_path", arity)
