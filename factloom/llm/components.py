"""Connected components of an edge list, without the driver holding any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut_small


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): the least id of each node's component. edges has long columns a and b; nodes without an edge are not in the result.

    Large-star and small-star rounds: each node's neighbours are linked to the least of them, first those above the node, then those below it, until nothing changes. Rows per round never exceed the edges."""
    e, _ = cut_small(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = e.union(e.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).filter("x <> y").union(low.select("a", "m")).distinct().toDF("a", "b")
        e, _ = cut_small(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not stable after {rounds} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
