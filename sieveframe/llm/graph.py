"""Connected components by alternating stars, all state in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(pairs: DataFrame) -> DataFrame:
    """pairs(u, v): every v hangs on the smallest node next to u (u itself included).

    The minimum is pre-aggregated on the map side; the join back is a plain shuffle join whose large
    side adaptive execution may split, so a node with very many neighbours needs no single task.
    """
    low = materialize(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
    return pairs.join(low, pairs.u == low.k).select("u", "v", "m")


def _stars(pairs: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and none both hangs on one and holds others: then all is done."""
    ends = pairs.where("u != v").select(F.col("u").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(pairs.where("u != v").select(F.col("v").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(u, v); component is the smallest node reachable.

    Edges of a node to itself keep it as a component of its own. Null ends are dropped. The number of
    rounds grows with the logarithm of the longest path.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).na.drop()
    pairs = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if _stars(pairs):
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(pairs.where("u = v")).distinct()
        star = _star(materialize(large))
        pairs = materialize(star.select("v", "m").unionByName(star.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    else:
        raise RuntimeError("connected components did not converge")
    return pairs.unionByName(pairs.select(F.col("v").alias("u"), "v")).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
