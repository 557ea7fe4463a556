"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentika.llm.common import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of every node that has a link to another; the component is its smallest node.

    Every round points the larger neighbours of each node to its smallest one, then the smaller
    ones, until each component is a star. Rounds grow with the logarithm of its size. Only whole
    columns of links are grouped and joined; each round is written to shared storage.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = written(links.where(F.col(a) != F.col(b)).select(u, v).distinct(), "links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links"
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one smaller node that points nowhere."""
    own = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    if own.where("n > 1").limit(1).count():
        return False
    return not edges.select("v").join(own.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
