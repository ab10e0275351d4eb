"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, root) for every node of an edge; root is the least node of its component.

    Each step takes the least neighbour by a partial aggregation and hangs the neighbours on it through a join on the
    node; the edge table (two numbers a row) is checkpointed after each round and never leaves the executors.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = materialize(pairs)
    while True:
        # Large star: every larger neighbour of u hangs on the least of u and its neighbours.
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours hang on the least of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # Done when the edges are stars: no node has two roots, no root hangs on another.
        twice = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
        hanging = pairs.select(F.col("v").alias("u")).join(pairs.select("u"), "u", "left_semi")
        if not twice.unionByName(hanging).limit(1).count():
            break
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
