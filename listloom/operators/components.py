"""Connected components of a link table (used by C1 and C4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every linked node; the component is its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected
    Components in MapReduce and Beyond" (2014): log-squared rounds, links never grow in
    number. Neighbour minima are plain aggregations, so a node with very many links is
    combined map-side. Each round is written to the shared folder, which ends its lineage;
    the round before is deleted.
    """
    e = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()
    e = cut(e, "links")
    last = None
    for _ in range(max_rounds):
        before, e = e, cut(_small_star(_large_star(e)), "links")
        discard(before)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def _large_star(e: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    moved = both.filter("v > u").join(least, "u")
    return moved.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Links the smaller neighbours of a node, and the node, to the smallest of them."""
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = e.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
