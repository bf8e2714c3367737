"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root): for every node of edges (a, b) the smallest node that it is connected with.

    Each round links a node's larger neighbours to its smallest one (large star), then its smaller ones (small star);
    the number of rounds grows with the logarithm of the longest path. Minima are aggregated before they are shuffled and
    joined back, so a node with very many neighbours is never gathered in one task. Rounds are written to the shared
    folder. Self-links and repeats are harmless; null ends are dropped.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()
    e = stored(e, "edges")
    before = None
    for _ in range(max_rounds):
        # large star: the larger neighbours of each node go to its least neighbour or itself
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: the smaller neighbours and the node itself go to the least
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        kept = e.join(least, "u")
        e = kept.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = stored(e, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
