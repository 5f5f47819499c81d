"""Connected components of an edge list by alternating star contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlytics.llm.storage import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours point to the smallest of them and itself: the larger neighbours, or the node and the smaller ones."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    if large:
        out = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = both.join(least, "a").select("b", "m").union(least.select("a", "m")).toDF("a", "b")
    return out.where(F.col("a") != F.col("b"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node either has one edge, to its component's smallest, or is that one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return roles.where("up > 1 OR up = 1 AND least = 0").agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """`node` and `label`, the smallest node of its component, for the nodes of edges given as `a` and `b` (long).

    Loops and repeated edges don't matter, rows with a null are left out; no edges give no rows. The rounds needed grow with
    the logarithm of the component's size; each is written to the checkpoint folder.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.col("a").cast("long"), F.col("b").cast("long"))
    while True:
        now = checkpointed(_star(_star(now, True), False).distinct())
        if _are_stars(now):
            break
    # the contraction ends in stars: every node but a component's smallest has one edge, to that
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())
