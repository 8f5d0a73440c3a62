"""Connected components of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.session import stage, unstage


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); nodes share a root if links connect them.

    In every round each node joins the neighbour that comes first in a random order of the
    round, if that is ahead of itself, and links become links between what nodes have joined:
    the link to that neighbour keeps both together. Links that have become loops or repeats go,
    so rounds shrink by a constant share, whatever the shape. Every round is written.
    """
    live = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    labels = stage(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    n = 0
    while not live.isEmpty():
        order = lambda c, n=n: F.xxhash64(F.col(c), F.lit(n))
        both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(live.select(F.col("b").alias("u"), F.col("a").alias("v")))
        first = both.groupBy("u").agg(F.min_by("v", order("v")).alias("v"))
        joined = stage(first.select("u", F.when(order("v") < order("u"), F.col("v")).otherwise(F.col("u")).alias("to")), "joined")
        moved = lambda c: joined.select(F.col("u").alias(c), F.col("to").alias(f"{c}_to"))
        linked = live.join(moved("a"), "a").join(moved("b"), "b").where("a_to <> b_to")
        linked = stage(linked.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "links")
        relabelled = stage(labels.join(moved("root"), "root", "left").select("node", F.coalesce("root_to", "root").alias("root")), "roots")
        for old in (live, labels, joined):
            unstage(old)
        live, labels, n = linked, relabelled, n + 1
    unstage(live)
    return labels
