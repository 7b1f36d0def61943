"""Connected components on DataFrames: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root) of every node in links (a long, b long); root is the least node of its component.

    Every round takes the least label among a node's neighbours, then the label's own
    label; a label that reaches a hub through one round spreads to all of it in the next,
    so rounds grow with the logarithm of the longest path. Labels are aggregated before
    the shuffle, so a hub costs one row a task.
    """
    both = scratch.keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{name}-links")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        moved = scratch.keep(least.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("root")), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        labels = moved.select("node", "root")
        if moved.filter("old <> root").isEmpty():
            scratch.drop(f"{name}-links")
            return labels
