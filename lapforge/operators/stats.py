"""Weighted and origin-constrained statistics as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import ordered


def time_weights(df: DataFrame, keys: list[str], order: str, clock: str, out: str = "weight") -> DataFrame:
    """Interval before each row, not below 0; the first copies the second's; a lone row weighs 1."""
    w = ordered(keys, order)
    forward = lambda d: F.when(d.isNotNull(), F.greatest(d, F.lit(0).cast("double")))  # noqa: E731  greatest alone would take a null for 0
    step, following = forward(F.col(clock) - F.lag(clock).over(w)), forward(F.lead(clock).over(w) - F.col(clock))
    return df.withColumn(out, F.coalesce(step, following, F.lit(1).cast("double")))


def weighted_percent(weight: str, condition: Column) -> Column:
    """100 * weight where the condition holds / all weight (0 over no weight)."""
    total = F.sum(weight)
    return F.when(total > 0, 100 * F.sum(F.when(condition, F.col(weight)).otherwise(0.0)) / total).otherwise(0.0)


def origin_fit(x: str, y: str) -> tuple[Column, Column]:
    """Slope of the least-squares line through the origin, and R squared about zero."""
    xx, xy, yy = F.sum(F.col(x) * F.col(x)), F.sum(F.col(x) * F.col(y)), F.sum(F.col(y) * F.col(y))
    slope = xy / F.nullif(xx, F.lit(0).cast("double"))
    return slope, 1 - (yy - slope * xy) / F.nullif(yy, F.lit(0).cast("double"))


def lower_percentile(df: DataFrame, keys: list[str], value: Column, q: float, out: str) -> DataFrame:
    """The value of 0-based index floor(q * n) in ascending order: an order statistic, not interpolated.

    Found by rank, so no group is gathered into one array.
    """
    df = df.select(*keys, value.alias("_v")).where("_v is not null")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = df.withColumns({"_rank": rank, "_n": n})
    return ranked.where(F.col("_rank") == F.floor(F.lit(q) * F.col("_n"))).select(*keys, F.col("_v").alias(out))


def median_and_spread(df: DataFrame, keys: list[str], value: str, least: int = 2) -> DataFrame:
    """Median (the mean of the middle two if even) and population deviation of groups of ``least`` rows or more."""
    out = df.groupBy(*keys).agg(F.median(value).alias("median"), F.stddev_pop(value).alias("spread"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least)


def clamped_extremes(value: str) -> tuple[Column, Column]:
    """(largest positive, largest negative as a positive number), each at least 0."""
    return F.greatest(F.lit(0.0), F.max(value)), F.greatest(F.lit(0.0), -F.min(value))
