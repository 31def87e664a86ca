"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans import materialise, scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """``node`` and ``component`` (the least node id reachable) of every node of an edge table.

    Alternates large-star and small-star steps: each points the neighbours of a node to the least
    of them, which halves distances and never makes more edges than there were. A step is a grouped
    minimum and an equi-join, combined before the shuffle, so a node of very high degree is no
    single task's work; each round is written out, so the plan does not grow and a lost executor
    repeats one round at most, and rounds are removed in the end. Loops and repeated edges are
    allowed; an empty table gives an empty result; a node id that is null is ignored."""
    with scratch(edges.sparkSession) as result:
        both = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x is not null and y is not null")
        now = materialise(
            both.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges"
        )
        before = None
        for _ in range(rounds):
            # large star: every larger neighbour of u goes to u's least neighbour
            each = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = each.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
            large = each.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            # small star: every smaller neighbour of u, and u, goes to the least of them
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            now = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
            state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == before:
                break
            before = state
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        nodes = both.select(F.explode(F.array("x", "y")).alias("node")).distinct()
        named = nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
        return result(named.select("node", F.coalesce("root", "node").alias("component")), "components")
