"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), in either direction, to (node, root): root is the least node of the component.

    Each step is an aggregation and a join on node ids. The edge table of each round is written to the shared folder,
    and so are the aggregates, so that adaptive execution can split the edges of a hot node in the join. Nodes without an edge to another node are not listed.
    """
    high, low = F.greatest("u", "v"), F.least("u", "v")
    now = stage(edges.filter("u <> v").select(high.alias("u"), low.alias("v")).distinct())
    while True:
        both = now.union(now.select("v", "u"))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large)
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new = stage(small)
        sums = [x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (now, new)]
        now = new
        if sums[0] == sums[1]:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
