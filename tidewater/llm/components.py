"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Columns ``a`` and ``b`` of ``edges`` (64-bit ids) -> ``node``, ``root`` (the smallest id reachable).

    Alternates the public large-star and small-star steps until every node has one link, to a node that has none. Both keep
    at most one row per link; each round is written to the shared folder. Nodes without links are absent.
    """
    links = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour (or the node).
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "links")
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links = materialize(small, "links")
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 OR up = 1 AND root = 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
