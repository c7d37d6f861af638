"""Heading rate from the driven path, and the unit of broadcast accelerations fitted against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats
from .windows import ordered

# Gravity (m/s2), half span of a heading (m), least rows, R squared, reference (m/s2), speed (m/s) and slope of a fit.
GRAVITY = 9.80665
HEADING_SPAN = 8
LEAST_ROWS, LEAST_R2, LEAST_REFERENCE, LEAST_SPEED, LEAST_SLOPE = 150, 0.75, 1.5, 8.0, 1e-3


def heading_rate(samples: DataFrame, lap: list[str], order: str, out: str = "heading_rate") -> DataFrame:
    """Signed turn (rad/s) between the chords to the first row at most 8 m behind and the first at least 8 m ahead.

    Needs t, dist, pos_x and pos_z, dist rising within a lap. Past the end of a lap its last row
    stands in; rows without a row on both sides, and laps of fewer than five, get 0.
    """
    by_dist = Window.partitionBy(*lap).orderBy("dist")
    place = F.struct("dist", "t", F.col("pos_x").alias("x"), F.col("pos_z").alias("z"))
    whole = Window.partitionBy(*lap).orderBy("dist").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = samples.withColumn("_p", place)
    rows = rows.withColumns({
        "_lo": F.first("_p").over(by_dist.rangeBetween(-HEADING_SPAN, 0)),
        "_hi": F.coalesce(F.first("_p").over(by_dist.rangeBetween(HEADING_SPAN, Window.unboundedFollowing)), F.last("_p").over(whole)),
        "_n": F.count("*").over(Window.partitionBy(*lap)),
    })
    chord = lambda a, b, c: F.col(f"{b}.{c}") - F.col(f"{a}.{c}")
    still = lambda a, b: (chord(a, b, "x") == 0) & (chord(a, b, "z") == 0)  # noqa: E731  no chord points along x
    along = lambda a, b: (F.when(still(a, b), 1.0).otherwise(chord(a, b, "x")), chord(a, b, "z"))
    (ax, az), (bx, bz) = along("_lo", "_p"), along("_p", "_hi")
    turn = F.atan2(ax * bz - az * bx + 0.0, ax * bx + az * bz)  # within (-pi, pi]; a half turn is +pi
    dt = (F.col("_hi.t") - F.col("_lo.t")) / 2
    usable = (F.col("_n") >= 5) & (F.col("_lo.dist") < F.col("dist")) & (F.col("_hi.dist") > F.col("dist")) & (dt > 0)
    return rows.withColumn(out, F.when(usable, turn / dt).otherwise(0.0)).drop("_p", "_lo", "_hi", "_n")


def acceleration_calibration(samples: DataFrame, lap: list[str], order: str, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(lap, available, and for both axes slope, r2, samples, fitted, g; unit): fits through the origin against the path.

    Needs t, dist, speed (km/h), pos_x, pos_z, acc_lat and acc_long. A weak fit takes the raw unit for m/s2.
    """
    rows = heading_rate(samples, lap, order)
    w = ordered(lap, order)
    v = F.col("speed") / 3.6
    rows = rows.withColumn("_v", v)
    dt = F.lead("t").over(w) - F.lag("t").over(w)
    rows = rows.withColumn("_long", F.coalesce(F.when(dt > 0, (F.lead("_v").over(w) - F.lag("_v").over(w)) / dt), F.lit(0.0)))
    rows = rows.withColumn("_lat", F.col("_v") * F.col("heading_rate"))
    aggs: list[Column] = [F.count_if(F.col("acc_lat").isNotNull() & F.col("acc_long").isNotNull()).alias("_n")]
    for axis in ("lat", "long"):
        usable = (F.col("_v") >= LEAST_SPEED) & (F.abs(f"_{axis}") >= LEAST_REFERENCE) & F.col(f"acc_{axis}").isNotNull()
        rows = rows.withColumns({f"_x_{axis}": F.when(usable, F.col(f"_{axis}")), f"_y_{axis}": F.when(usable, F.col(f"acc_{axis}"))})
        slope, r2 = stats.origin_fit(f"_x_{axis}", f"_y_{axis}")
        aggs += [F.coalesce(slope, F.lit(0.0)).alias(f"_s_{axis}"), F.coalesce(r2, F.lit(0.0)).alias(f"_r_{axis}"), F.count(f"_x_{axis}").alias(f"{axis}_samples")]
    agg = rows.groupBy(*lap).agg(*aggs)
    out = [F.col("_n") >= least_rows]
    fitted = {a: (F.col(f"{a}_samples") >= least_rows) & (F.col(f"_r_{a}") >= LEAST_R2) & (F.abs(f"_s_{a}") >= LEAST_SLOPE) for a in ("lat", "long")}
    both = F.array_compact(F.array(*[F.when(fitted[a], F.round(F.abs(f"_s_{a}"), 5)) for a in ("lat", "long")]))
    mean = F.aggregate(both, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(both), F.lit(0))
    unit = (
        F.when(mean.isNull(), "unverified").when(mean.between(0.7, 1.4), "m/s^2").when(mean.between(0.07, 0.14), "g")
        .otherwise(F.concat(F.lit("1 unit = "), F.round(1 / mean, 3).cast("string"), F.lit(" m/s^2")))
    )
    columns = [*map(F.col, lap), out[0].alias("available")]
    for a in ("lat", "long"):
        g = F.when(fitted[a], F.round(1 / (F.col(f"_s_{a}") * GRAVITY), 6)).otherwise(F.round(F.lit(1 / GRAVITY), 6))
        columns += [F.round(f"_s_{a}", 5).alias(f"{a}_slope"), F.round(f"_r_{a}", 4).alias(f"{a}_r2"), F.col(f"{a}_samples"), fitted[a].alias(f"{a}_fitted"), g.alias(f"{a}_g")]
    return agg.select(*columns, unit.alias("unit"))
