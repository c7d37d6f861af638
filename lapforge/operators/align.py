"""Alignment on a common axis: as-of interpolation, nearest sample and deltas.

A query set (keys, x) is joined to samples (keys, x, values) by one union and one window
per key with last/first non-null, so both neighbours are known without a range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours(samples: DataFrame, queries: DataFrame, keys: list[str], x: str, values: list[str]) -> DataFrame:
    """Queries with ``lo`` and ``hi`` structs (x, values): the last sample at or before, the first at or after."""
    row = F.struct(F.col(x).alias("x"), *[F.col(v).alias(v) for v in values])
    both = samples.select(*keys, F.col(x).alias("_x"), F.lit(0).alias("_q"), row.alias("_s"))
    both = both.unionByName(queries.select(*keys, F.col(x).alias("_x"), F.lit(1).alias("_q")), allowMissingColumns=True)
    order = Window.partitionBy(*keys)
    lo = F.last("_s", ignorenulls=True).over(order.orderBy(F.col("_x"), F.col("_q")).rowsBetween(Window.unboundedPreceding, 0))
    hi = F.last("_s", ignorenulls=True).over(order.orderBy(F.col("_x").desc(), F.col("_q")).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumns({"lo": lo, "hi": hi}).where("_q = 1").select(*keys, F.col("_x").alias(x), "lo", "hi")


def interpolate(samples: DataFrame, queries: DataFrame, keys: list[str], x: str, values: list[str]) -> DataFrame:
    """Linear blend of the two neighbours, clamped at the ends. Sample x must be distinct by key."""
    near = neighbours(samples, queries, keys, x, values)
    span = F.col("hi.x") - F.col("lo.x")
    part = F.when(span > 0, (F.col(x) - F.col("lo.x")) / span).otherwise(0.0)
    blend = lambda v: F.when(F.col("lo").isNull(), F.col(f"hi.{v}")).when(F.col("hi").isNull(), F.col(f"lo.{v}")).otherwise(F.col(f"lo.{v}") + (F.col(f"hi.{v}") - F.col(f"lo.{v}")) * part)
    return near.select(*keys, x, *[blend(v).alias(v) for v in values])


def nearest(samples: DataFrame, queries: DataFrame, keys: list[str], x: str, values: list[str]) -> DataFrame:
    """Values of the nearest sample; an exact tie goes to the earlier one."""
    near = neighbours(samples, queries, keys, x, values)
    later = F.col("lo").isNull() | (F.col("hi.x") - F.col(x) < F.col(x) - F.col("lo.x"))
    pick = F.when(later & F.col("hi").isNotNull(), F.col("hi")).otherwise(F.col("lo"))
    return near.withColumn("_p", pick).select(*keys, x, *[F.col(f"_p.{v}").alias(v) for v in values])


def grid(samples: DataFrame, keys: list[str], x: str, step: float) -> DataFrame:
    """(keys, grid_i, x): points 0, step, ... up to the last sample of each key."""
    ends = samples.groupBy(*keys).agg(F.max(x).alias("_end"))
    points = ends.select(*keys, F.explode(F.sequence(F.lit(0), F.floor(F.col("_end") / step).cast("int"))).alias("grid_i"))
    return points.withColumn(x, F.col("grid_i") * F.lit(float(step)))


def resample(samples: DataFrame, keys: list[str], x: str, values: list[str], step: float) -> DataFrame:
    """Values interpolated on the grid of each key."""
    out = interpolate(samples, grid(samples, keys, x, step), keys, x, values)
    return out.withColumn("grid_i", F.round(F.col(x) / step).cast("int"))


def delta(samples: DataFrame, key: str, x: str, clock: str, reference: object, step: float) -> DataFrame:
    """Clock difference in ms to the reference key at equal x, on the shorter of both axes; positive is slower."""
    even = resample(samples, [key], x, [clock], step)
    base = even.where(F.col(key) == reference).select("grid_i", F.col(clock).alias("_base"))
    return even.where(F.col(key) != reference).join(base, "grid_i").select(key, "grid_i", x, ((F.col(clock) - F.col("_base")) * 1000).alias("delta_ms"))
