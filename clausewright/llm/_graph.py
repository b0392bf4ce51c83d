"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm._shared import checkpointed


def _stars(edges: DataFrame) -> DataFrame:
    """One round over edges (u > v): every greater neighbour is hung on the least one known, then every lesser one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    near = large.join(least, "u")
    small = near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component (the least id reachable) for every end of the edges (a, b); nothing but two sums is gathered. Self edges and nulls are left out."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), (F.col("a") != F.col("b")).alias("_two"))
    edges = checkpointed(edges.where("_two").select("u", "v").distinct())
    state = None
    for _ in range(most_rounds):
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == state or not now[0]:
            break
        state = now
        edges = checkpointed(_stars(edges))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
