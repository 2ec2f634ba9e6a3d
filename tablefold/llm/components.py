"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import checkpointed


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the least of u and its neighbours v."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): for each node of edges (u, v) the least node that it is connected to.

    Each round writes its edges to the checkpoint folder; the number of rounds
    grows with the logarithm of the longest path. Loops and repeated edges are
    allowed. A node with very many edges costs one row for each in a join that
    adaptive execution splits.
    """
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # edges now lead from larger to smaller nodes, as small stars need them
        small = _least(large)
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        edges = checkpointed(hung.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
