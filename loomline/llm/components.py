"""Connected components of a graph that is never collected: alternating stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: Parts among which the links of one node are dealt out: the middle of a large component may have a third of all.
PARTS = 32


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each neighbour of a node to the least of them; the larger ones only, or the smaller ones and the node.

    A node's links are worked on in parts: the least of each part goes up, the least of all comes down to at most PARTS rows, and each link
    meets its own part.
    """
    dealt = edges.withColumn("_part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))
    of_part = dealt.groupBy("u", "_part").agg(F.min("v").alias("m"))
    least = of_part.groupBy("u").agg(F.min("m").alias("m")).withColumn("m", F.least("m", "u"))
    both = dealt.join(of_part.select("u", "_part").join(least, "u"), ["u", "_part"])
    if large:
        return both.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return both.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u != v")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link; component is the least node reachable.

    links: columns a and b of one orderable type; links in either direction, repeats and loops are allowed, nulls are left out.
    Large and small stars alternate until nothing changes; each round is written to the shared folder, so a lost
    executor costs one round at most. An empty table gives no rows.
    """
    links = links.filter("a is not null and b is not null and a != b")
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    seen = edges.agg(F.count("*"), total).first()
    while True:
        if not seen[0]:
            break
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(around, large=True).distinct()
        edges = written(_star(large, large=False).distinct(), "links")
        now = edges.agg(F.count("*"), total).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
