"""Connected components by rounds of hooking and pointer jumping, with checkpoints in the shared folder."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of this machine where all runs on it (tests)."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lumenspan-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def spanning_forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n nodes linked by (i, j): the nodes that reach a smaller one, and the smallest that each reaches."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the ends of edges (a, b): label is the smallest node that is reached.

    Each round joins the edges with the labels of their ends, keeps those whose ends
    differ as edges between labels, hooks roots to smaller roots and shortens the
    chains, so edges dwindle and rounds are about the logarithm of the longest path.
    Nothing is collected; every round ends in a checkpoint.
    """
    shared_dir(edges.sparkSession)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    ends = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")))
    label = ends.groupBy("node").agg(F.min("label").alias("label")).checkpoint()
    while True:
        left = label.select(F.col("node").alias("u"), F.col("label").alias("lu"))
        right = label.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        edges = edges.join(left, "u").join(right, "v").where("lu <> lv").select(F.greatest("lu", "lv").alias("u"), F.least("lu", "lv").alias("v")).distinct().checkpoint()
        if edges.isEmpty():
            return label
        hooks = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("to"))
        while True:
            jump = hooks.alias("x").join(hooks.alias("y"), F.col("x.to") == F.col("y.node"), "left").select("x.node", F.coalesce("y.to", "x.to").alias("to"), F.col("y.to").isNotNull().alias("moved")).checkpoint()
            hooks = jump.select("node", "to")
            if jump.where("moved").isEmpty():
                break
        label = label.join(hooks.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")).checkpoint()
