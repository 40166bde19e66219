"""Connected components of a graph that no task and no driver holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescale.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge; the root is the smallest node of its component.

    Every round joins each node's larger neighbours, then its smaller ones, to the smallest
    neighbour. Minima combine before they are shuffled, so a node with very many edges is no
    hot spot, and a round never has more edges than the one before, plus one for each node. Rounds
    grow with the logarithm of the longest chain. Each round is a written table: a lost executor
    costs one task, and lineage stays short. Edges with a null end, and loops, are ignored; no
    edges give no rows.
    """
    clean = edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
    now = materialize(clean.filter((F.col("x") != F.col("y")) & F.col(a).isNotNull() & F.col(b).isNotNull()).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("low")).select("x", F.least("x", "low").alias("low"))
        large = both.filter("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("low").alias("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("low"))
        small = (
            large.join(least, "x")
            .select(F.explode(F.array(F.struct(F.col("x"), F.col("low")), F.struct(F.col("y").alias("x"), F.col("low")))).alias("e"))
            .select("e.x", F.col("e.low").alias("y"))
            .filter("x > y")
            .distinct()
        )
        now = materialize(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("y").alias("x"), "y").distinct()
    return now.unionByName(roots).select(F.col("x").alias("node"), F.col("y").alias("root"))
