"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.session import durable


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component: for each endpoint of edges(src, dst) the least node it is connected with.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each
    round is two aggregations by node, and the number of rounds grows with the
    logarithm of the size. Self-loops make a component of one node; rows with
    a null endpoint are left out. An empty table gives an empty result.
    """
    known = edges.where("src is not null and dst is not null")
    nodes = known.select(F.col("src").alias("node")).union(known.select("dst")).distinct()
    links = durable(
        known.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = durable(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    """component, size."""
    return components.groupBy("component").agg(F.count("*").alias("size"))

