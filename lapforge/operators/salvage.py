"""Laps of a packet stream, with those salvaged whose end the lap counter never showed.

A lap is completed when the counter steps on by one with a reported time. A stream may break off at the line instead (a replay
that ends, a menu, another car): then the buffered ticks are a lap if a time that the console reported, now or in the packet before, agrees with the
time that the ticks took. The lap clock in the packets cuts the buffer into stretches (pre-roll, lap, stub), the latest that agrees is the lap. A salvaged
lap ends its session; the packet at which it is noticed belongs to no lap unless it begins a session itself.

This is the batch form, windows and joins over whole streams; ``streaming.laps`` gives the same rows packet by packet.
Columns: key, order, packet_id, car_id, current_lap, total_laps, on_track, paused, loading, last_ms, best_ms (-1: none), clock_ms (null: none), speed (m/s), fuel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.sources.scratch import staged

from . import windows
from .lifecycle import CLOCK_JUMP

# Longest gap in frames that counts as time; least ticks of a lap; tolerance (ms and share) of a match; most ticks of a lap-0 buffer.
FRAME_GAP, MIN_TICKS, TOLERANCE_MS, TOLERANCE_SHARE, LAP0_TICKS = 60, 600, 500, 0.005, 54_000
COLUMNS = ("packet_id", "car_id", "current_lap", "total_laps", "on_track", "paused", "loading", "last_ms", "best_ms", "clock_ms", "speed", "fuel")


def matched_time(reported: Column, duration_ms: Column) -> Column:
    """The first of the reported times that agrees with a duration (null: none)."""
    near = F.greatest(F.lit(float(TOLERANCE_MS)), duration_ms * TOLERANCE_SHARE)
    return F.get(F.filter(reported, lambda c: (c > 0) & (F.abs(c - duration_ms) <= near)), F.lit(0))


def runs(packets: DataFrame, key: str, order: str) -> DataFrame:
    """Packets outside of loading with ``frames`` since the last, whether they begin a run (``step``) or a session (``torn``), and the run: what one counter and car buffer."""
    driven = packets.where(~F.col("loading")).select(key, F.col(order).alias("at"), *COLUMNS)
    driven = driven.withColumn("prev", F.lag(F.struct("car_id", "current_lap", "packet_id", "last_ms", "best_ms", "fuel")).over(windows.ordered([key], "at")))
    gap = F.col("packet_id") - F.col("prev.packet_id")
    torn = (F.col("prev.car_id") != F.col("car_id")) | ((F.col("prev.current_lap") > 0) & F.col("current_lap").between(0, F.col("prev.current_lap") - 1))
    driven = driven.withColumns({"frames": F.when(gap.between(1, FRAME_GAP), gap).otherwise(1).cast("long"), "torn": F.coalesce(torn, F.lit(False))})
    step = F.col("prev").isNull() | F.col("torn") | (F.col("prev.current_lap") != F.col("current_lap"))
    driven = driven.withColumn("step", step)
    return driven.withColumn("run", F.sum(F.col("step").cast("long")).over(windows.upto([key], "at")))


def attempts(packets: DataFrame, driven: DataFrame, key: str, order: str) -> DataFrame:
    """(key, run, at, reported, loading, torn, complete, last_ms, next_fuel, prev_fuel): where a run may end: at its loading packets, and at the first packet of the next run."""
    complete = ~F.col("torn") & (F.col("prev.current_lap") > 0) & (F.col("current_lap") == F.col("prev.current_lap") + 1) & (F.col("last_ms") > 0)
    times = lambda *c: F.array(*[F.col(x).cast("long") for x in c]).alias("reported")
    ends = driven.where("step and run > 1").select(
        key, (F.col("run") - 1).alias("run"), "at", times("last_ms", "best_ms", "prev.last_ms", "prev.best_ms"), F.lit(False).alias("loading"), "torn",
        complete.alias("complete"), F.col("last_ms").cast("long").alias("last_ms"), F.col("fuel").cast("double").alias("next_fuel"), F.col("prev.fuel").cast("double").alias("prev_fuel"),
    )
    # a loading packet belongs to the run of the last packet before it
    state = driven.select(key, "at", F.struct("run", "last_ms", "best_ms", "fuel").alias("s"))
    kind = state.schema["s"].dataType
    loads = packets.where("loading").select(key, F.col(order).alias("at"), F.lit(None).cast(kind).alias("s"), "last_ms", "best_ms").withColumn("asks", F.lit(True))
    both = state.withColumns({"last_ms": F.lit(None).cast(packets.schema["last_ms"].dataType), "best_ms": F.lit(None).cast(packets.schema["best_ms"].dataType), "asks": F.lit(False)}).unionByName(loads)
    both = both.withColumn("s", F.last("s", ignorenulls=True).over(windows.upto([key], "at"))).where("asks and s is not null")
    none = lambda t: F.lit(None).cast(t)
    loads = both.select(
        key, "s.run", "at", times("last_ms", "best_ms", "s.last_ms", "s.best_ms"), F.lit(True).alias("loading"), F.lit(False).alias("torn"), F.lit(False).alias("complete"),
        none("long").alias("last_ms"), none("double").alias("next_fuel"), F.col("s.fuel").cast("double").alias("prev_fuel"),
    )
    return ends.unionByName(loads)


def _stretches(ticks: DataFrame, run: list[str], least: int) -> DataFrame:
    """(run, prefix, segment, ticks, end, from, to, n) of the buffers (run, prefix) of at least ``least`` ticks: stretches of the lap clock without frozen head and tail."""
    own = [*run, "prefix"]
    lead, inner, upto = Window.partitionBy(*own), windows.ordered(own, "nth"), windows.upto(own, "nth")
    b = ticks.withColumn("ticks", F.count("*").over(lead)).where(F.col("ticks") >= least)
    b = b.withColumns({"i": F.row_number().over(inner) - 1, "whole": F.count("clock_ms").over(lead) == F.col("ticks")})
    # tenths of a millisecond since the first tick; metres include the first step
    b = b.withColumn("tenths", F.round(F.sum(F.when(F.col("i") == 0, 0).otherwise(F.col("frames"))).over(upto) * 10000 / 60).cast("long"))
    b = b.withColumn("dist", F.round(F.sum(F.col("speed") * F.col("frames") / 60).over(upto), 2))
    jump = F.col("whole") & (F.col("clock_ms") + CLOCK_JUMP < F.lag("clock_ms").over(inner))
    b = b.withColumn("segment", F.sum(F.coalesce(jump, F.lit(False)).cast("int")).over(upto))
    within = windows.ordered([*own, "segment"], "nth")
    b = b.withColumns({"rises": F.lead("clock_ms").over(within) > F.col("clock_ms"), "rose": F.col("clock_ms") > F.lag("clock_ms").over(within)})
    tick = F.struct("i", "tenths", "dist", "fuel")
    s = b.groupBy(*own, "segment", "whole", "ticks").agg(F.min(tick).alias("a"), F.max(tick).alias("z"), F.min(F.when(F.col("rises"), tick)).alias("head"), F.max(F.when(F.col("rose"), tick)).alias("tail"))
    ahead = F.when(F.col("whole"), F.coalesce("head", "z")).otherwise(F.col("a"))
    behind = F.when(F.col("whole"), F.coalesce("tail", "z")).otherwise(F.col("z"))
    s = s.select(*own, "segment", "ticks", F.col("z").alias("end"), ahead.alias("from"), behind.alias("to"))
    return s.withColumn("n", F.col("to.i") - F.col("from.i") + 1)


def lap_stream(packets: DataFrame, key: str, order: str, min_ticks: int = MIN_TICKS, lap0_ticks: int = LAP0_TICKS) -> DataFrame:
    """(key, order, session, lap, time_ms, ticks, trimmed, length_m, fuel_start, fuel_end, salvaged): a row a lap, at the packet that ended it.

    Every run is tried with and without its first packet, as a lap salvaged before it may have taken that; which one holds is settled
    in the end along the runs. Each round takes the first attempt of every run that succeeds; one made while loading leaves the rest of the run
    for the next round, so rounds follow the most laps salvaged within one run. A run's ticks are looked at once for each of its stretches of loading packets.
    Streams with a null key or order are left out.
    """
    packets = packets.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    driven = staged(runs(packets, key, order), "driven")
    tries_of = staged(attempts(packets, driven, key, order), "attempts")
    recorded = F.col("on_track") & ~F.col("paused") & (F.col("current_lap") >= 0) & ~((F.col("total_laps") > 0) & (F.col("total_laps") < F.col("current_lap")))
    samples = driven.where(recorded).select(key, "run", "at", "current_lap", "frames", "speed", "clock_ms", F.col("fuel").cast("double").alias("fuel"))
    first = driven.groupBy(key, "run").agg(F.min("at").alias("first"))
    end = tries_of.where("not loading and not torn and not complete").select(key, (F.col("run") + 1).alias("run"), F.lit(True).alias("may"))
    first = staged(first.join(end, [key, "run"], "left").withColumn("may", F.coalesce("may", F.lit(False))), "first-packets")
    floors = first.withColumn("late", F.explode(F.when(F.col("may"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    floors = staged(floors.select(key, "run", "late", (F.col("first") - 1 + F.col("late")).alias("floor")), "floors")
    run, done = [key, "run", "late"], None
    while True:
        asked = tries_of.join(floors, [key, "run"]).where("at > floor")
        held = samples.join(floors, [key, "run"]).where("at > floor")
        nth = F.row_number().over(windows.ordered(run, "at")) - 1
        held = held.withColumn("nth", nth).withColumn("chunk", F.when(F.col("current_lap") == 0, F.floor(F.col("nth") / lap0_ticks)).otherwise(0))
        mark = asked.select(*run, "at", F.lit(0).alias("one"), F.lit(True).alias("asks")).unionByName(held.select(*run, "at", F.lit(1).alias("one"), F.lit(False).alias("asks")))
        mark = mark.withColumn("prefix", F.sum("one").over(windows.upto(run, "at"))).where("asks").select(*run, "at", "prefix")
        asked = staged(asked.join(mark, [*run, "at"]), "tries")
        ends = asked.where(F.col("prefix") > 0).select(*run, "prefix").distinct()
        # of a lap 0, only the ticks since the buffer was last full
        full = F.when(F.col("current_lap") == 0, F.floor((F.col("prefix") - 1) / lap0_ticks)).otherwise(0)
        ticks = held.join(ends, run).where((F.col("nth") < F.col("prefix")) & (F.col("chunk") == full))
        seg = staged(_stretches(ticks, run, min_ticks), "stretches")
        whole = seg.groupBy(*run, "prefix").agg(F.max("ticks").alias("ticks"), F.max("end").alias("end"))
        asked = asked.join(whole, [*run, "prefix"])
        pick = asked.where("not complete").drop("ticks", "end").join(seg.where(F.col("n") >= min_ticks).drop("ticks", "end"), [*run, "prefix"])
        pick = pick.withColumn("time_ms", matched_time(F.col("reported"), F.bround((F.col("to.tenths") - F.col("from.tenths")) / 10)))
        best = pick.where("time_ms is not null").groupBy(*run, "at").agg(F.max(F.struct("segment", "time_ms", "from", "to", "n")).alias("m"))
        won = asked.join(best, [*run, "at"], "left").where("complete or m is not null")
        won = won.withColumn("r", F.row_number().over(windows.ordered(run, "at"))).where("r = 1")
        part = F.col("m").isNotNull() & (F.col("m.n") < F.col("ticks"))
        made = won.select(
            *run, "at", "floor", "loading", "torn", F.col("m").isNotNull().alias("salvaged"), F.coalesce("m.time_ms", "last_ms").alias("time_ms"),
            F.coalesce("m.n", "ticks").cast("long").alias("ticks"), (F.col("ticks") - F.coalesce("m.n", "ticks")).cast("long").alias("trimmed"),
            F.round(F.when(part, F.col("m.to.dist") - F.col("m.from.dist")).otherwise(F.col("end.dist")), 2).alias("length_m"), F.col("m.from.fuel").alias("fuel_start"),
            F.when(F.col("m").isNotNull(), F.col("prev_fuel")).otherwise(F.col("next_fuel")).alias("fuel_end"),
        )
        made = staged(made, "laps-made")
        done = made if done is None else done.unionByName(made)
        floors = staged(made.where("loading").select(*run, F.col("at").alias("floor")), "floors")
        if floors.isEmpty():
            return _numbered(driven, staged(_settled(first, done, key), "laps"), key, order)


def _settled(first: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """The laps of each run in the form that holds: without its first packet if the run before it ended in a salvage there."""
    took = made.where("not loading and not torn and salvaged").groupBy(key, "run").agg(F.max((F.col("late") == 0).cast("int")).alias("early"), F.max((F.col("late") == 1).cast("int")).alias("late"))
    r = first.join(took.withColumnRenamed("late", "later"), [key, "run"], "left").na.fill(0, ["early", "later"])
    r = r.withColumn("later", F.when(F.col("may"), F.col("later")).otherwise(F.col("early")))  # others never begin late
    # a run hands on early if it began early and later if it began late: where both agree, what came before does not matter
    w = windows.upto([key], "run")
    r = r.withColumn("sure", F.col("early") == F.col("later")).withColumn("block", F.sum(F.col("sure").cast("int")).over(w))
    since = windows.upto([key, "block"], "run")
    base = F.coalesce(F.first(F.when(F.col("sure"), F.col("early"))).over(since), F.lit(0))
    turns = F.sum((~F.col("sure") & (F.col("early") == 1)).cast("int")).over(since)
    r = r.withColumn("hands", (base + turns) % 2)
    r = r.withColumn("late", F.coalesce(F.lag("hands").over(windows.ordered([key], "run")), F.lit(0)))
    return made.join(r.select(key, "run", "late"), [key, "run", "late"])


def _numbered(driven: DataFrame, laps: DataFrame, key: str, order: str) -> DataFrame:
    """Laps with their session, counter and the fuel at the start of a completed one."""
    after = laps.where("salvaged and not torn").select(key, "at", F.lit(True).alias("mark"), F.lit(False).alias("torn"))
    line = driven.select(key, "at", F.lit(False).alias("mark"), "torn").unionByName(after)
    # the first packet of a stream, of another car or a lower counter, and the first one after a salvage begin sessions
    salvages = F.sum(F.col("mark").cast("int")).over(Window.partitionBy(key).orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    line = line.withColumn("behind", F.coalesce(salvages, F.lit(0))).where("not mark")
    line = line.withColumn("new", F.col("torn") | ~F.col("behind").eqNullSafe(F.lag("behind").over(windows.ordered([key], "at"))))
    starts = line.where("new").select(key, "at", F.lit(1).alias("one"))
    marks = starts.unionByName(laps.select(key, "at", F.lit(0).alias("one")))
    ahead = Window.partitionBy(key).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    session = marks.withColumn("session", F.sum("one").over(ahead)).where("one = 0").select(key, "at", "session")
    begin = driven.select(key, "run", F.col("at").alias("b"), "current_lap", F.col("fuel").cast("double").alias("begin_fuel"))
    start = laps.join(begin, [key, "run"]).where("b > floor").groupBy(key, "at").agg(F.min(F.struct("b", "begin_fuel", "current_lap")).alias("s"))
    out = laps.join(session, [key, "at"]).join(start, [key, "at"])
    return out.select(
        key, F.col("at").alias(order), F.col("session").cast("long").alias("session"), F.col("s.current_lap").cast("long").alias("lap"), "time_ms", "ticks", "trimmed", "length_m",
        F.when(F.col("salvaged"), F.col("fuel_start")).otherwise(F.col("s.begin_fuel")).alias("fuel_start"), "fuel_end", "salvaged",
    )
