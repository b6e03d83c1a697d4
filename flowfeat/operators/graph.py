"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowfeat.sources.shared import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b). Nodes without edges are not in it.

    Large-star and small-star steps in turn: each hangs neighbours on the least node known, so paths shrink by half or more
    a round. Every round is one written table; a hub with many neighbours is a skewed key of a join that Spark splits.
    """

    def star(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("a").agg(F.min("b").alias("__m")).select(F.col("a").alias("__u"), F.least("a", "__m").alias("m"))
        return pairs.join(low, F.col("a") == F.col("__u"))

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        before = state
        both = now.union(now.select("b", "a"))
        large = star(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = star(large)
        last, now = now, cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", "m")).filter("a <> b").distinct(), "edges")
        drop(last)
