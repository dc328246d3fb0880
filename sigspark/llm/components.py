"""Connected components of a graph in a DataFrame, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for each node of an edge; root is the smallest node of its component.

    Each round links nodes to the smallest of their neighbourhood, which ends in stars after O(log^2 n) rounds; it runs
    until nothing changes. Minima are partial aggregates and come back by a join, which splits where a hub is hot, so no
    neighbourhood is gathered in one task. Nodes and edges stay in Spark; only counts reach the driver. Self-loops,
    repeated and reversed edges do no harm; null ends are no edges; no edges give an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e)
    state = _state(e)
    for _ in range(most_rounds):
        # large star: the larger neighbours of u, and of these each to the minimum around u
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours, each to the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        hung = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(hung.union(low.select("u", F.col("m").alias("v"))).distinct())
        new = _state(e)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(e: DataFrame) -> tuple:
    """Equal for equal sets of edges: their number and two sums of hashes."""
    h = F.xxhash64("u", "v")
    r = e.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum((h % 1000003) * (h % 999983))).first()
    return tuple(r)
