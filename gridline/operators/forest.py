"""A fitted forest as arrays of nodes, walked with built-in functions."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_dir


def node_arrays(spark: SparkSession, model: RandomForestClassificationModel) -> DataFrame:
    """One row of arrays over all nodes of all trees: feature, threshold, left, right, share (of class 1), and roots.

    Children are places in the arrays, -1 for leaves. Taken from the nodes that the model writes;
    their number is bounded by trees and depth.
    """
    path = f"{scratch_dir(spark)}/forest-{uuid.uuid4().hex[:8]}"
    model.write().save(path)
    node = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"].alias("id"), node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        (F.get(node["impurityStats"], F.lit(1)) / F.aggregate(node["impurityStats"], F.lit(0.0), lambda t, v: t + v)).alias("share"))
    # A tree's nodes are numbered from 0 without gaps, so its root stands where the trees before it end.
    sizes = nodes.groupBy("treeID").agg(F.count("*").alias("n"))
    roots = sizes.select("treeID", (F.sum("n").over(Window.orderBy("treeID")) - F.col("n")).cast("int").alias("root"))
    placed = nodes.join(F.broadcast(roots), "treeID")
    child = lambda c: F.when(F.col(c) < 0, -1).otherwise(F.col("root") + F.col(c))
    row = F.struct((F.col("root") + F.col("id")).alias("at"), "feature", "threshold", child("left").alias("left"), child("right").alias("right"),
                   "share", "root", "id")
    rows = placed.agg(F.array_sort(F.collect_list(row)).alias("nodes"))
    field = lambda c: F.transform("nodes", lambda n: n[c]).alias(c)
    starts = F.transform(F.filter("nodes", lambda n: n["id"] == 0), lambda n: n["root"]).alias("roots")
    return rows.select(*[field(c) for c in ("feature", "threshold", "left", "right", "share")], starts)


def forest_score(df: DataFrame, model: RandomForestClassificationModel, features: list[str], out: str) -> DataFrame:
    """``df`` with ``out``, the mean share of class 1 in the leaves that a row reaches. [M10]

    Every tree is walked down to its depth at most; a value up to the threshold goes left.
    """
    trees = node_arrays(df.sparkSession, model).select(F.struct("*").alias("_trees"))
    t, x = F.col("_trees"), F.col("_x")

    def step(at: Column, _: Column) -> Column:
        goes_left = F.get(x, F.get(t["feature"], at)) <= F.get(t["threshold"], at)
        return F.when(F.get(t["left"], at) < 0, at).when(goes_left, F.get(t["left"], at)).otherwise(F.get(t["right"], at))

    levels = F.sequence(F.lit(1), F.lit(max(1, model.getMaxDepth())))
    total = F.aggregate(t["roots"], F.lit(0.0), lambda s, root: s + F.get(t["share"], F.aggregate(levels, root, step)))
    rows = df.withColumns({"_x": F.array(*[F.col(f).cast("double") for f in features]), "_trees": trees.scalar()})
    return rows.withColumn(out, total / F.size(t["roots"])).drop("_x", "_trees")
