"""The life of a lap: clock segments, clock drift, span verdicts, crossings of the finish line.

A session is a key and its laps or packets have an order; all of it is windows and aggregates,
so a session is never gathered into one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import before, ordered, segments, upto

# Clock jump (ms); share of the reference span of a full lap, with and without enough laps;
# laps in the reference; laps for a median; speed (m/s) and number of crossings kept; crossings and spread (m) to trust.
CLOCK_JUMP = 250
FULL_SHARE, FIRST_SHARE = 0.97, 0.93
SPAN_LAPS, MEDIAN_LAPS = 5, 3
CROSSING_SPEED, CROSSINGS_KEPT = 5.0, 50
SURE_CROSSINGS, SURE_SPREAD = 2, 15.0


def clock_segments(df: DataFrame, keys: list[str], order: str, clock: str, jump: int = CLOCK_JUMP) -> DataFrame:
    """(keys, segment, first, last): stretches between backward jumps of over ``jump``, without frozen head and tail.

    The head ends at the first row whose next one is later, the tail begins after the last row
    later than the one before; a clock that never rises leaves its last row. Null clocks are left out.
    """
    df = df.where(F.col(clock).isNotNull())
    df = segments(df, keys, order, F.col(clock) + jump < F.lag(clock).over(ordered(keys, order)), "segment")
    within = ordered([*keys, "segment"], order)
    marks = df.select(
        *keys, "segment", F.col(order).alias("_at"),
        F.when(F.lead(clock).over(within) > F.col(clock), F.col(order)).alias("_head"),
        F.when(F.col(clock) > F.lag(clock).over(within), F.col(order)).alias("_tail"),
    )
    end = F.max("_at")
    return marks.groupBy(*keys, "segment").agg(F.coalesce(F.min("_head"), end).alias("first"), F.coalesce(F.max("_tail"), end).alias("last"))


def clock_drift(df: DataFrame, keys: list[str], order: str, elapsed_ms: str, lap_clock: str) -> DataFrame:
    """(keys, samples, drift, worst): how far two clocks part since the lap clock last fell back; the first row of a stretch is its base."""
    df = df.where(F.col(lap_clock).isNotNull() & F.col(elapsed_ms).isNotNull())
    df = segments(df, keys, order, F.col(lap_clock) < F.lag(lap_clock).over(ordered(keys, order)), "_anchor")
    stretch = [*keys, "_anchor"]
    df = df.withColumn("_offset", F.col(elapsed_ms) - F.col(lap_clock))
    df = df.withColumns({"_base": F.first("_offset").over(upto(stretch, order)), "_nth": F.row_number().over(ordered(stretch, order))})
    drift = F.when(F.col("_nth") > 1, F.bround(F.col("_offset") - F.col("_base")).cast("long"))
    df = df.withColumn("_drift", drift)
    return df.groupBy(*keys).agg(
        F.count("_drift").alias("samples"),
        F.coalesce(F.max_by("_drift", F.when(F.col("_drift").isNotNull(), F.col(order))), F.lit(0)).alias("drift"),
        F.coalesce(F.max(F.abs("_drift")), F.lit(0)).alias("worst"),
    )


def span_verdicts(laps: DataFrame, session: str, order: str, number: str, span: str, time: str) -> DataFrame:
    """Add ``reference``, ``confirmed``, ``counts`` and ``best_before``.

    ``reference`` is the span of a full lap as known when the lap arrived: the median of the last
    five, the longest of fewer than three. ``confirmed`` says that at least two of these reach it.
    ``counts`` is the final verdict, by the reference of the session's last lap; a lone lap counts.
    ``best_before`` is the least time of earlier laps that count. Of a repeated number the last lap
    stays; laps without number or span are left out.
    """
    laps = laps.where(F.col(number).isNotNull() & F.col(span).isNotNull())
    newest = F.row_number().over(Window.partitionBy(session, number).orderBy(F.col(order).desc()))
    laps = laps.withColumn("_new", newest).where("_new = 1").drop("_new")
    mine, whole = ordered([session], order), ordered([session], order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    laps = laps.withColumns({"_near": F.array_sort(F.collect_list(span).over(mine.rowsBetween(1 - SPAN_LAPS, 0))), "_n": F.row_number().over(mine)})
    size = F.size("_near")
    at = lambda i: F.element_at("_near", i.cast("int"))
    median = (at(F.floor((size + 1) / 2)) + at(F.floor(size / 2) + 1)) / 2
    laps = laps.withColumn("reference", F.when(size < MEDIAN_LAPS, F.element_at("_near", -1)).otherwise(median).cast("double"))
    reach = F.size(F.filter("_near", lambda x: x >= F.col("reference") * FULL_SHARE))
    laps = laps.withColumn("confirmed", (F.col("_n") >= MEDIAN_LAPS) & (F.col("reference") > 0) & (reach >= MEDIAN_LAPS - 1))
    laps = laps.withColumns({"_all": F.last("_n").over(whole), "_final": F.last("reference").over(whole)})
    share = F.when(F.col("_all") >= MEDIAN_LAPS, FULL_SHARE).otherwise(FIRST_SHARE)
    laps = laps.withColumn("counts", (F.col("_all") == 1) | (F.col(span) >= F.col("_final") * share))
    best = F.min(F.when(F.col("counts"), F.col(time))).over(before([session], order))
    return laps.withColumn("best_before", best).drop("_near", "_n", "_all", "_final")


def finish_crossings(df: DataFrame, keys: list[str], order: str, lap: str, speed: str, x: str, z: str, vx: str, vz: str) -> DataFrame:
    """(keys, order, lap, x, z, hx, hz): where the lap counter goes up by one from 1 or more at speed, the first fifty of a key; to millimetres, headings to 5 places."""
    norm = F.sqrt(F.col(vx) * F.col(vx) + F.col(vz) * F.col(vz))
    last = F.lag(lap).over(ordered(keys, order))
    df = df.withColumns({"_last": last, "_norm": norm})
    df = df.where((F.col("_last") >= 1) & (F.col(lap) == F.col("_last") + 1) & (F.col(speed) >= CROSSING_SPEED) & (F.col("_norm") > 0))
    df = df.withColumn("_r", F.row_number().over(ordered(keys, order))).where(F.col("_r") <= CROSSINGS_KEPT)
    return df.select(*keys, order, lap, F.round(x, 3).alias("x"), F.round(z, 3).alias("z"), F.round(F.col(vx) / F.col("_norm"), 5).alias("hx"), F.round(F.col(vz) / F.col("_norm"), 5).alias("hz"))


def finish_line(crossings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Mean place and heading of the crossings of a key; the first heading where they cancel out."""
    all_rows = Window.partitionBy(*keys)
    c = crossings.withColumns({"_mx": F.avg("x").over(all_rows), "_mz": F.avg("z").over(all_rows)})
    far = F.sqrt((F.col("x") - F.col("_mx")) ** 2 + (F.col("z") - F.col("_mz")) ** 2)
    agg = c.groupBy(*keys).agg(
        F.first("_mx").alias("_mx"), F.first("_mz").alias("_mz"), F.count("*").alias("crossings"), F.max(far).alias("_far"),
        F.sum("hx").alias("_hx"), F.sum("hz").alias("_hz"), F.min_by(F.struct("hx", "hz"), order).alias("_one"),
    )
    norm = F.sqrt(F.col("_hx") * F.col("_hx") + F.col("_hz") * F.col("_hz"))
    mean = lambda s, one: F.when(norm < 0.1, F.col(f"_one.{one}")).otherwise(F.col(s) / norm)
    return agg.select(
        *keys, F.round("_mx", 2).alias("x"), F.round("_mz", 2).alias("z"), F.round(mean("_hx", "hx"), 5).alias("hx"), F.round(mean("_hz", "hz"), 5).alias("hz"),
        "crossings", F.round("_far", 1).alias("spread"), ((F.col("crossings") >= SURE_CROSSINGS) & (F.col("_far") <= SURE_SPREAD)).alias("confident"),
    )
