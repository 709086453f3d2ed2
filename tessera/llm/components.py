"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step groups edges by one endpoint and points its neighbours at the least of them, so the number of rounds grows
with the logarithm of a component's size. A hot vertex's edges are reduced by partial aggregation (its least
neighbour) and a join that Spark can split; they are never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(id, component) for each id in edges (a, b): component is the least id reachable from it. Raises an error rather than give unfinished ones."""
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", few=True)
    seen = None
    for _ in range(most_rounds):
        # Large star: each larger neighbour of v is joined to the least of v and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: v and its smaller neighbours are joined to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        then = scratch.keep(small, "stars", few=True)
        mark = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = then
        if seen == mark:
            break
        seen = mark
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
