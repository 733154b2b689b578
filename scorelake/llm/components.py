"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node of the component.

    Every step is a grouped minimum and a join; edges stay distributed and are written after each round,
    so a lost executor costs one round at most.  An empty edge table gives an empty result.
    """
    pair = lambda x, y: F.struct(x.alias("u"), y.alias("v"))
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        held = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(held) == state or not held[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v"))).distinct()
        state = tuple(held)
        both = now.select(F.explode(F.array(pair(F.col("u"), F.col("v")), pair(F.col("v"), F.col("u")))).alias("e")).select("e.*")
        # Written first, so that the rows of a node with very many edges can be split in the join.
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = cut(small.where("u <> v").distinct(), now, large, least)
