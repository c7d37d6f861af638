"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that an edge names; the component is its smallest node.

    Each round is two aggregations by node with map-side minima, staged to cut lineage;
    the number of rounds grows with the logarithm of the longest path. Self-loops and
    repeated edges change nothing; an empty table gives an empty result.
    """
    x, y = F.least(a, b).alias("u"), F.greatest(a, b).alias("v")
    now = staged(edges.select(x, y).where("u < v").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v"), F.col("m")).where("v > m").distinct()
        least = large.groupBy("v").agg(F.min("m").alias("m2"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m2").alias("u")), F.struct(F.col("m").alias("v"), F.col("m2").alias("u")))).alias("e"))
        after = staged(small.select("e.u", "e.v").where("u < v").distinct(), "edges")
        mark = [F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))]
        if now.agg(*mark).first() == after.agg(*mark).first():
            star = after.select(F.col("v").alias("node"), F.col("u").alias("component"))
            return star.unionByName(after.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
        now = after
