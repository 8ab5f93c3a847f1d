"""Connected components of a distributed edge list by alternating stars.

Each round points every node's larger neighbours at its smallest one, then
every node's smaller neighbours likewise (two-phase star contraction, O(log^2)
rounds). A round is two grouped minima, which aggregate partially before their
shuffle, and two joins that adaptive execution can split at a hub. Every round is
written to the shared folder; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airseries.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v"))


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) of every node with an edge: ``root`` is the smallest node reachable.

    ``edges`` has long columns u and v in any order; loops and repeats do no harm.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = written(edges.distinct(), "edges")
    state = None
    for _ in range(limit):
        edges = written(_small_star(_large_star(edges).where("u <> v").distinct()).distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
