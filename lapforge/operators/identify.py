"""Which circuit a lap was driven on, and which way round: signatures, whole laps, coverage decisions, direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import ordered

# Least length and closing distance (m) of a whole lap, closing share of its length; least coverage and lead
# of a match; cell (m) of the path search and positions tested a lap.
WHOLE_LENGTH, WHOLE_CLOSE, WHOLE_SHARE = 400.0, 60.0, 0.05
LEAST_COVERAGE, LEAST_LEAD = 0.60, 0.25
PATH_CELL, DIRECTION_TESTS = 20.0, 80


def signatures(samples: DataFrame, lap: list[str], order: str, dist: str, x: str, z: str) -> DataFrame:
    """(lap, length, min_x, max_x, min_z, max_z, whole): one aggregate a lap.

    A whole lap is long enough and ends near its start. Rows without distance or position are left out.
    """
    rows = samples.where(F.col(dist).isNotNull() & F.col(x).isNotNull() & F.col(z).isNotNull())
    agg = rows.groupBy(*lap).agg(
        F.count("*").alias("_n"), F.max_by(dist, order).alias("length"), F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(z).alias("min_z"), F.max(z).alias("max_z"),
        F.min_by(F.struct(F.col(x).alias("x"), F.col(z).alias("z")), order).alias("_a"), F.max_by(F.struct(F.col(x).alias("x"), F.col(z).alias("z")), order).alias("_b"),
    )
    gap = F.sqrt((F.col("_b.x") - F.col("_a.x")) ** 2 + (F.col("_b.z") - F.col("_a.z")) ** 2)
    near = F.greatest(F.lit(WHOLE_CLOSE), F.col("length") * WHOLE_SHARE)
    whole = (F.col("_n") >= 2) & (F.col("length") >= WHOLE_LENGTH) & (gap <= near)
    return agg.select(*lap, "length", "min_x", "max_x", "min_z", "max_z", whole.alias("whole"))


def match_decision(scores: DataFrame, lap: list[str], track: str, coverage: str, least: float = LEAST_COVERAGE, lead: float = LEAST_LEAD) -> DataFrame:
    """(lap, track, coverage): the best covered track of a lap, if it covers enough and leads the next by enough."""
    w = Window.partitionBy(*lap).orderBy(F.col(coverage).desc(), F.col(track).desc())
    ranked = scores.withColumns({"_r": F.row_number().over(w), "_next": F.coalesce(F.lead(coverage).over(w), F.lit(0.0))})
    clear = (F.col("_r") == 1) & (F.col(coverage) >= least) & (F.col(coverage) - F.col("_next") >= lead)
    return ranked.where(clear).select(*lap, track, coverage)


def travel_direction(samples: DataFrame, path: DataFrame, lap: list[str], order: str, track: str, cell: float = PATH_CELL) -> DataFrame:
    """(lap, direction): share of steps along the path less those against it, in [-1, 1]; 0 where nothing tells.

    samples (lap, order, track, x, z); path (track, j, x, z) with j from 0. About eighty positions of a
    lap are tested by rule; each goes to the nearest path point of the 3 x 3 cells around it (ties to
    the smaller j) by an equi-join on track and cell. Paths of fewer than eight points tell nothing.
    """
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    n = F.count("*").over(Window.partitionBy(*lap))
    rows = samples.withColumns({"_i": F.row_number().over(ordered(lap, order)) - 1, "_n": n})
    rows = rows.where((F.col("_n") >= 2) & (F.col("_i") % F.greatest(F.lit(1), F.floor(F.col("_n") / DIRECTION_TESTS)) == 0))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    rows = rows.select(*lap, "_i", track, "x", "z", around.alias("_c"))
    rows = rows.withColumns({"_cx": at("x") + F.col("_c.a"), "_cz": at("z") + F.col("_c.b")})
    total = path.groupBy(track).agg(F.count("*").alias("_total")).where("_total >= 8")
    points = path.select(track, "j", F.col("x").alias("_px"), F.col("z").alias("_pz"), at("x").alias("_cx"), at("z").alias("_cz")).join(total, track)
    away = (F.col("_px") - F.col("x")) ** 2 + (F.col("_pz") - F.col("z")) ** 2
    found = rows.join(points, [track, "_cx", "_cz"]).groupBy(*lap, "_i").agg(F.min(F.struct(away.alias("d"), F.col("j"))).alias("_m"), F.first("_total").alias("_total"))
    found = found.withColumn("_step", F.pmod(F.col("_m.j") - F.lag("_m.j").over(ordered(lap, "_i")), F.col("_total")))
    ahead, back = (F.col("_step") > 0) & (F.col("_step") < F.col("_total") / 2), F.col("_step") >= F.col("_total") / 2
    agg = found.groupBy(*lap).agg(F.count_if(ahead).alias("_f"), F.count_if(back).alias("_b"))
    share = F.when(F.col("_f") + F.col("_b") > 0, (F.col("_f") - F.col("_b")) / (F.col("_f") + F.col("_b"))).otherwise(0.0)
    return samples.select(*lap).distinct().join(agg, lap, "left").select(*lap, F.coalesce(share, F.lit(0.0)).alias("direction"))
