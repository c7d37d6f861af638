"""The race engineer's detectors over laps and packets: pace, lap times, race marks, tyres, off-road, fuel, alerts.

Each rule is windows and aggregates by session; what it would say is left to the reader of its columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import relational
from .windows import before, ordered, upto

# Laps, milliseconds, degrees, ticks, m/s and litres of the rules.
PACE_LAPS, PACE_COUNTED, PACE_DROP, PACE_CLEAR, PACE_STEP = 3, 4, 800, 400, 500
LEAST_GAP = 50
HALFWAY_LAPS = 4
TYRE_GAP = 8.0
LOOSE_WHEELS, LOOSE_SPEED, LOOSE_TICKS, ROAD_TICKS = 3, 8.0, 30, 120
LEAST_BURN = 0.01
FUEL_WARN, FUEL_CRITICAL = 3.0, 1.5
WATER_WARN, WATER_CRITICAL, OIL_WARN, OIL_CRITICAL = 110, 120, 130, 140
OIL_PRESSURE, OIL_RPM, TYRE_WARN = 2.0, 2000, 110

# Event type, category, priority, life (ms), cooldown (s), whether it interrupts.
POLICIES = [
    ("engineer_enabled", "system", 20, 8000, 0, False),
    ("test", "system", 20, 10000, 0, False),
    ("lap_time", "lap", 60, 10000, 0, False),
    ("personal_best", "pace", 70, 12000, 0, False),
    ("pace_drop", "pace", 62, 12000, 0, False),
    ("final_lap", "race", 85, 10000, 0, False),
    ("race_halfway", "race", 35, 10000, 0, False),
    ("position_gained", "position", 65, 5000, 3, False),
    ("position_lost", "position", 65, 5000, 3, False),
    ("fuel_remaining", "fuel", 30, 12000, 0, False),
    ("fuel_low", "fuel", 75, 12000, 60, False),
    ("fuel_critical", "fuel", 95, 10000, 30, True),
    ("fuel_short", "strategy", 90, 15000, 0, True),
    ("pit_window_next", "strategy", 80, 15000, 0, False),
    ("pit_window_open", "strategy", 80, 15000, 0, False),
    ("water_temp_high", "engine", 90, 10000, 20, False),
    ("water_temp_critical", "engine", 95, 10000, 20, True),
    ("oil_temp_high", "engine", 90, 10000, 20, False),
    ("oil_temp_critical", "engine", 95, 10000, 20, True),
    ("oil_pressure_low", "engine", 98, 10000, 10, True),
    ("tire_temp_high", "tires", 45, 15000, 30, False),
    ("tire_imbalance", "tires", 45, 20000, 0, False),
    ("repeated_lockups", "coaching", 45, 25000, 0, False),
    ("repeated_wheelspin", "coaching", 45, 25000, 0, False),
    ("repeated_bottoming", "chassis", 40, 25000, 0, False),
    ("braking_early", "coaching", 48, 25000, 120, False),
    ("braking_late", "coaching", 48, 25000, 120, False),
    ("corner_time_loss", "coaching", 50, 25000, 0, False),
]


def policies(spark: SparkSession) -> DataFrame:
    """One row an event type: category, priority, life, cooldown and whether it interrupts; small enough to join anywhere."""
    return spark.createDataFrame(POLICIES, "event_type string, category string, priority int, life_ms long, cooldown_s int, interrupts boolean")


def pace_drops(laps: DataFrame, session: str, order: str, time: str, counts: Column) -> DataFrame:
    """(session, order, average, best, spell, severity): laps at which the mean of the last three lies 0.8 s or more off the best.

    Laps that don't count are left out; four must count. ``spell`` counts the recoveries before: a mean
    within 0.4 s of the best, or a lap of the three that is, after a drop.
    """
    mine, three = upto([session], order), ordered([session], order).rowsBetween(1 - PACE_LAPS, 0)
    df = laps.where(counts)
    df = df.withColumns({"_n": F.count("*").over(mine), "average": F.avg(time).over(three), "best": F.min(time).over(mine), "_least": F.min(time).over(three)})
    drop = F.col("average") - F.col("best")
    ready = F.col("_n") >= PACE_COUNTED
    clear = ready & ((F.col("_least") - F.col("best") < PACE_CLEAR) | (drop < PACE_CLEAR))
    df = df.withColumn("_sign", F.when(clear, 0).when(ready & (drop >= PACE_DROP), 1))
    df = df.withColumn("_was", F.last("_sign", ignorenulls=True).over(before([session], order)))
    df = df.withColumn("spell", F.count_if((F.col("_sign") == 0) & (F.col("_was") == 1)).over(mine))
    return df.where("_sign = 1").select(session, order, "average", "best", "spell", F.floor(drop / PACE_STEP).cast("int").alias("severity"))


def lap_callouts(laps: DataFrame, session: str, order: str, time: str, counts: Column) -> DataFrame:
    """(session, order, time, event_type, delta, told): personal bests and lap times of laps that count.

    ``delta`` is the time less the best before (0 without one); ``told`` says that it is large enough to tell.
    """
    df = laps.where(counts & (F.col(time) > 0)).withColumn("_best", F.min(time).over(before([session], order)))
    delta = F.coalesce(F.col(time) - F.col("_best"), F.lit(0))
    kind = F.when(delta < 0, "personal_best").otherwise("lap_time")
    return df.select(session, order, time, kind.alias("event_type"), delta.cast("long").alias("delta"), (F.abs(delta) >= LEAST_GAP).alias("told"))


def race_marks(packets: DataFrame, session: list[str], order: str, lap: str, total: str) -> DataFrame:
    """(session, event_type, at): the first packet of the last lap, and the first past half of a race of four laps or more but before its last lap."""
    on = packets.where((F.col(total) > 0) & (F.col(lap) > 0))
    half = (F.col(total) >= HALFWAY_LAPS) & (F.col(lap) > F.col(total) / 2) & (F.col(lap) < F.col(total))
    first = on.groupBy(*session).agg(F.min(F.when(F.col(lap) == F.col(total), F.col(order))).alias("_final"), F.min(F.when(half, F.col(order))).alias("_half"))
    both = F.explode(F.array(F.struct(F.lit("final_lap").alias("event_type"), F.col("_final").alias("at")), F.struct(F.lit("race_halfway").alias("event_type"), F.col("_half").alias("at"))))
    return first.select(*session, both.alias("_e")).select(*session, "_e.*").where("at is not null")


def tyre_balance(samples: DataFrame, lap: list[str], fl: str, fr: str, rl: str, rr: str) -> DataFrame:
    """(lap, axis, hotter, degrees): the larger imbalance of the mean tyre temperatures of a lap, if it is 8 degrees or more."""
    mean = samples.groupBy(*lap).agg(*[F.avg(c).alias(n) for c, n in ((fl, "_fl"), (fr, "_fr"), (rl, "_rl"), (rr, "_rr"))])
    pair = lambda a, b: (F.col(a) + F.col(b)) / 2
    mean = mean.withColumns({"_axle": pair("_rl", "_rr") - pair("_fl", "_fr"), "_side": pair("_fl", "_rl") - pair("_fr", "_rr")})
    by_axle = F.abs("_axle") >= F.abs("_side")
    hotter = F.when(by_axle, F.when(F.col("_axle") > 0, "rear").otherwise("front")).otherwise(F.when(F.col("_side") > 0, "left").otherwise("right"))
    gap = F.greatest(F.abs("_axle"), F.abs("_side"))
    return mean.where(gap >= TYRE_GAP).select(*lap, F.when(by_axle, "front_rear").otherwise("left_right").alias("axis"), hotter.alias("hotter"), F.bround(gap).cast("long").alias("degrees"))


def off_road(packets: DataFrame, keys: list[str], order: str, loose: str, speed: str, hold: int = LOOSE_TICKS, rearm: int = ROAD_TICKS) -> DataFrame:
    """(keys, at): excursions of ``hold`` ticks with three or more loose wheels at speed; after one, ``rearm`` other ticks in a row must pass.

    A run of ticks either reaches its length or not, so the rule is islands: an excursion counts if
    it is the first or a long enough run of other ticks lies since the last one. Rows without wheel
    states are left out.
    """
    rows = packets.where(F.col(loose).isNotNull()).withColumn("_off", F.coalesce((F.col(loose) >= LOOSE_WHEELS) & (F.col(speed) >= LOOSE_SPEED), F.lit(False)))
    turned = F.coalesce(F.col("_off") != F.lag("_off").over(ordered(keys, order)), F.lit(True)).cast("int")
    rows = rows.withColumn("_turn", turned).withColumn("_run", F.sum("_turn").over(upto(keys, order)))
    rows = rows.withColumn("_nth", F.row_number().over(ordered([*keys, "_run"], order)))
    marks = rows.where((F.col("_off") & (F.col("_nth") == hold)) | (~F.col("_off") & (F.col("_nth") == rearm)))
    marks = marks.withColumn("_was", F.lag("_off").over(ordered(keys, order)))
    return marks.where("_off and not coalesce(_was, false)").select(*keys, F.col(order).alias("at"))


def strategy(states: DataFrame, laps: DataFrame, session: str, order: list[str], burn: str, time: str, car: str) -> DataFrame:
    """(session, burn, lap_time, n, laps_to_empty, pit_before_lap) of states (session, car, fuel_level, current_lap).

    From the last laps of the state's car that burned fuel; an unknown car on either side fits.
    """
    now = states.select(session, F.col(car).alias("_car"), "fuel_level", "current_lap")
    same = F.col(car).isNull() | F.col("_car").isNull() | (F.col(car) == F.col("_car"))
    fit = laps.join(now.select(session, "_car"), session).where(same & (F.col(burn) > LEAST_BURN))
    out = relational.fuel_projection(fit, session, order, burn, time).join(now, session)
    left = F.col("fuel_level") / F.col("burn")
    return out.select(session, "burn", "lap_time", "n", left.alias("laps_to_empty"), (F.col("current_lap") + F.floor(left)).cast("long").alias("pit_before_lap"))


def alerts(frames: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, place, id, severity): what a frame on the track warns of, critical before warn before info, else in order of the rules.

    Needs laps_to_empty, pit_before_lap, total_laps, current_lap, water_temp, oil_temp, oil_pressure, rpm, tyre_max;
    a null takes part in no rule.
    """
    level = lambda c, warn, critical: F.when(F.col(c) > critical, "critical").when(F.col(c) > warn, "warn")
    rules = [
        ("fuel", F.when(F.col("laps_to_empty") < FUEL_CRITICAL, "critical").when(F.col("laps_to_empty") < FUEL_WARN, "warn")),
        ("pit", F.when((F.col("total_laps") > 0) & (F.col("pit_before_lap") < F.col("total_laps")) & (F.col("pit_before_lap") <= F.col("current_lap") + 1), "info")),
        ("water", level("water_temp", WATER_WARN, WATER_CRITICAL)),
        ("oil-temp", level("oil_temp", OIL_WARN, OIL_CRITICAL)),
        ("oil-pressure", F.when((F.col("oil_pressure") >= 0) & (F.col("oil_pressure") < OIL_PRESSURE) & (F.col("rpm") > OIL_RPM), "critical")),
        ("tires", F.when(F.col("tyre_max") > TYRE_WARN, "warn")),
    ]
    rank = lambda s: F.when(s == "critical", 0).when(s == "warn", 1).otherwise(2)
    each = F.array(*[F.struct(rank(s).alias("rank"), F.lit(i).alias("rule"), F.lit(name).alias("id"), s.alias("severity")) for i, (name, s) in enumerate(rules)])
    said = F.array_sort(F.filter(each, lambda a: a["severity"].isNotNull()))
    return frames.select(*keep, F.posexplode(said).alias("place", "_a")).select(*keep, "place", "_a.id", "_a.severity")
