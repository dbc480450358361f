"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the smallest node that links reach.

    Each round hangs every node's larger neighbours under its smallest one (large star), then its
    smaller neighbours and itself (small star); both are a pre-aggregated minimum and a join that
    Spark can split, so a hub with a third of all nodes is no bottleneck. Rounds are written to the
    shared folder; they end when all links are stars, after O(log n) of them in practice.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, k = scratch.put(now, f"{name}0"), 0
    while not _stars(now):
        k += 1
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
        now = scratch.put(small.distinct(), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one root (b), and no root has another."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    # a node under two others, or both under one and over another
    broken = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 or (ups = 1 and low = 0)")
    return broken.isEmpty()
