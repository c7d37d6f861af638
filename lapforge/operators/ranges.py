"""Range joins by buckets: points in intervals, and the nearest point ahead or behind.

An interval is exploded to the buckets it crosses, so the join is an equi-join on (keys,
bucket) with a residual condition, never a product of both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str, high: str, bucket: float) -> DataFrame:
    """Pairs with low <= at < high on equal keys."""
    cell = lambda c: F.floor(c / bucket).cast("long")
    cut = intervals.where(F.col(high) > F.col(low)).withColumn("_b", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    pairs = points.withColumn("_b", cell(F.col(at))).join(cut, [*keys, "_b"])
    return pairs.where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_b")


def nearest_within(points: DataFrame, targets: DataFrame, keys: list[str], at: str, target: str, name: str, within: float, ahead: bool) -> DataFrame:
    """The target of least distance in [0, within) ahead of (or behind) each point; ties to the smaller name."""
    cell = lambda c: F.floor(c / within).cast("long")
    side = 1 if ahead else -1
    spread = points.withColumn("_b", F.explode(F.array(cell(F.col(at)), cell(F.col(at)) + side)))
    pairs = spread.join(targets.withColumn("_b", cell(F.col(target))), [*keys, "_b"])
    distance = (F.col(target) - F.col(at)) * side
    pairs = pairs.withColumn("distance", distance).where((F.col("distance") >= 0) & (F.col("distance") < within))
    return pairs.groupBy(*keys, at).agg(F.min(F.struct("distance", name)).alias("_m")).select(*keys, at, F.col(f"_m.{name}").alias(name), F.col("_m.distance").alias("distance"))
