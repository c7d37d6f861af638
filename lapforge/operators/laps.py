"""Laps from a packet table: sessions, laps, metrics, chassis events, fuel and race results.

Input is one row a packet with the columns of ``sources.packets.derived`` flattened:
console, packet_id, current_lap, car_id, on_track, paused, speed (km/h), throttle, brake
(percent), fuel, last_lap_time_ms, and slips and suspensions by wheel. Packet order is
``packet_id`` within a console. Everything is windows and aggregates by console and lap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats, windows

FRAME = 1 / 60
MIN_TICKS = 600
MAX_EVENTS = 40
WHEELS = ("fl", "fr", "rl", "rr")


def sessions(packets: DataFrame, key: str = "console", order: str = "packet_id") -> DataFrame:
    """Add ``session`` and ``frames``: a session starts at the first packet, on a new car, and when the lap counter falls from above 0.

    Frame gaps are taken over all packets, before any filter, so a pause adds one frame.
    """
    w = windows.ordered([key], order)
    last_lap, last_car = F.lag("current_lap").over(w), F.lag("car_id").over(w)
    starts = (last_car != F.col("car_id")) | ((last_lap > 0) & (F.col("current_lap") < last_lap))
    return windows.segments(windows.gap_frames(packets, [key], order, order), [key], order, starts, "session")


def ticks(packets: DataFrame, key: str = "console", order: str = "packet_id") -> DataFrame:
    """Recorded samples of every lap with ``i``, ``t`` (s) and ``dist`` (m): t starts at 0, dist includes the first step."""
    on = sessions(packets, key, order).where(F.col("on_track") & ~F.col("paused") & (F.col("current_lap") >= 0))
    lap = [key, "session", "current_lap"]
    step = F.col("frames") * F.lit(FRAME)
    out = windows.integrate(on, lap, order, F.col("speed") / 3.6 * step, "dist")
    out = windows.integrate(out, lap, order, step, "t", skip_first=True)
    return out.withColumn("i", F.row_number().over(windows.ordered(lap, order)) - 1)


def completed(packets: DataFrame, key: str = "console", order: str = "packet_id", min_ticks: int = MIN_TICKS) -> DataFrame:
    """(key, session, lap, time_ms, ticks): laps followed by the next counter with a reported time."""
    all_rows = sessions(packets, key, order)
    lap = [key, "session", "current_lap"]
    first = all_rows.groupBy(*lap).agg(F.min_by("last_lap_time_ms", order).alias("reported"))
    recorded = all_rows.where(F.col("on_track") & ~F.col("paused")).groupBy(*lap).agg(F.count("*").alias("ticks"))
    following = first.select(key, "session", (F.col("current_lap") - 1).alias("current_lap"), F.col("reported").alias("time_ms"))
    done = recorded.join(following, lap).where((F.col("current_lap") > 0) & (F.col("time_ms") > 0) & (F.col("ticks") >= min_ticks))
    return done.select(key, "session", F.col("current_lap").alias("lap"), F.col("time_ms").cast("long"), "ticks")


def metrics(samples: DataFrame, lap: list[str]) -> DataFrame:
    """Summary of each lap: time shares of pedals and spin, extremes, fuel used, ticks."""
    w = stats.time_weights(samples, lap, "i", "t")
    share = lambda c: stats.weighted_percent("weight", c)
    spin = reduce(lambda a, b: a | b, [F.col(f"slip_{x}") >= 1.1 for x in WHEELS])
    return w.groupBy(*lap).agg(
        F.count("*").alias("ticks"),
        share(F.col("throttle") >= 98).alias("full_throttle_pct"),
        share(F.col("brake") >= 98).alias("full_brake_pct"),
        share((F.col("throttle") == 0) & (F.col("brake") == 0)).alias("coasting_pct"),
        share(spin).alias("tire_spin_pct"),
        F.max("speed").alias("max_speed"),
        (F.max_by("fuel", F.struct(-F.col("i"))) - F.max_by("fuel", "i")).alias("fuel_consumed"),
        F.max("dist").alias("length_m"),
    )


def slip_events(samples: DataFrame, lap: list[str], min_ticks: int = 6) -> DataFrame:
    """Lockups and wheelspin: runs of ticks, first ``MAX_EVENTS`` a lap and type.

    A lockup brakes at 20 % or more with a slip under 0.9, its severity the least slip of all
    wheels; wheelspin has throttle at 40 % or more and a slip over 1.1, severity the largest.
    """
    low, high = F.least(*[f"slip_{x}" for x in WHEELS]), F.greatest(*[f"slip_{x}" for x in WHEELS])

    def runs(kind: str, active: Column, severity: Column) -> DataFrame:
        found = windows.islands(samples, lap, "i", active, min_ticks)
        order = Window.partitionBy(*lap).orderBy("first")
        found = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= MAX_EVENTS).drop("_r")
        within = samples.join(found.select(*[F.col(c).alias(f"_{c}") for c in lap], "first", "last"), reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in lap]))
        within = within.where(F.col("i").between(F.col("first"), F.col("last")))
        return within.groupBy(*lap, "first", "last").agg(F.lit(kind).alias("type"), F.min("dist").alias("start_dist"), F.max("dist").alias("end_dist"), severity.alias("severity"))

    lock = runs("lockup", (F.col("brake") >= 20) & (low < 0.9), F.min(low))
    spin = runs("wheelspin", (F.col("throttle") >= 40) & (high > 1.1), F.max(high))
    return lock.unionByName(spin)


def suspension_events(samples: DataFrame, lap: list[str], min_ticks: int = 3, top: float = 0.98) -> DataFrame:
    """Bottoming: runs at ``top`` of a wheel's range in the lap; and kerb strikes: spikes of over 35 % of the range; all of them.

    The wheels of a tick pass the windows side by side, in one sort of the ticks; only ticks of an event become rows of a wheel.
    """
    order, so_far, whole = windows.ordered(lap, "i"), windows.upto(lap, "i"), Window.partitionBy(*lap)
    each = lambda f: {k: v for x in WHEELS for k, v in f(x, F.col(f"sus_{x}")).items()}
    t = samples.select(*lap, "i", *[f"sus_{x}" for x in WHEELS])
    t = t.withColumns(each(lambda x, h: {f"_over_{x}": h - (F.lag(h, 2).over(order) + F.lead(h, 2).over(order)) / 2}))
    t = t.withColumns(each(lambda x, h: {f"_lo_{x}": F.min(h).over(whole), f"_range_{x}": F.max(h).over(whole) - F.min(h).over(whole)}))
    high = lambda x, h: F.coalesce((F.col(f"_range_{x}") > 0) & (h >= F.col(f"_lo_{x}") + top * F.col(f"_range_{x}")), F.lit(False))
    kerb = lambda x: F.coalesce((F.col(f"_range_{x}") > 0) & (F.col(f"_over_{x}") > 0.35 * F.col(f"_range_{x}")), F.lit(False))
    t = t.select(*lap, "i", *[c for x in WHEELS for c in (high(x, F.col(f"sus_{x}")).alias(f"_on_{x}"), kerb(x).alias(f"_kerb_{x}"))])
    t = t.withColumns({f"_start_{x}": (F.col(f"_on_{x}") & ~F.coalesce(F.lag(f"_on_{x}").over(order), F.lit(False))).cast("int") for x in WHEELS})
    t = t.withColumns({f"_run_{x}": F.sum(f"_start_{x}").over(so_far) for x in WHEELS})
    wheel = lambda x: F.struct(F.lit(x).alias("wheel"), F.col(f"_on_{x}").alias("on"), F.col(f"_kerb_{x}").alias("kerb"), F.col(f"_run_{x}").alias("run"))
    tall = t.select(*lap, "i", F.explode(F.filter(F.array(*[wheel(x) for x in WHEELS]), lambda w: w["on"] | w["kerb"])).alias("_w")).select(*lap, "i", "_w.*")
    bottom = tall.where("on").groupBy(*lap, "wheel", "run").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n")).where(F.col("n") >= min_ticks)
    one = lambda df, kind, a, b: df.select(*lap, F.lit(kind).alias("type"), "wheel", F.col(a).alias("first"), F.col(b).alias("last"))
    return one(bottom, "bottoming", "first", "last").unionByName(one(tall.where("kerb"), "kerb", "i", "i"))


def race_result(packets: DataFrame, key: list[str], order: str) -> DataFrame:
    """First packet past the last lap of each session, with the last valid position seen up to it."""
    w = windows.upto(key, order)
    valid = F.when((F.col("total_positions") >= 2) & (F.col("race_position") >= 1), F.col("race_position"))
    seen = packets.withColumn("final_position", F.last(valid, ignorenulls=True).over(w))
    done = seen.where((F.col("total_laps") > 0) & (F.col("current_lap") > F.col("total_laps")))
    first = F.row_number().over(windows.ordered(key, order))
    return done.withColumn("_r", first).where("_r = 1").select(*key, order, "final_position", "total_positions", F.col("total_laps").alias("race_laps"))
