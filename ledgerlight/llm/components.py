"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.common import stored


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Edges point from the larger node ``u`` to the smaller ``v``.  Large-star ties a node's
    larger neighbours to the smallest node it knows, small-star its smaller ones; both only
    need each node's minimum, which is folded before it is shuffled.  When every node begins one
    edge at most and no edge ends where another begins, nodes point at their components.
    Self-loops and repeated edges do no harm.
    """
    a, b = F.col(left), F.col(right)
    links = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))
        large = (
            links.select(F.col("u").alias("far"), F.col("v").alias("u")).join(least, "u")
            .select(F.col("far").alias("u"), F.col("m").alias("v"))
            .union(least.filter("m < u").select("u", F.col("m").alias("v")))
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
        )
        links = stored(small.distinct())
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("begins"), F.lit(0).alias("ends")).union(
            links.select("v", F.lit(0), F.lit(1))
        ).groupBy("node").agg(F.sum("begins").alias("begins"), F.max("ends").alias("ends"))
        if ends.filter("begins + ends > 1 AND begins > 0").isEmpty():
            break
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
