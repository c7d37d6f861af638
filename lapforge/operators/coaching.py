"""Coaching notes of a session's laps, replayed: habits against the best lap so far, each said once.

Laps run in order of number and id; a lap's reference is the fastest full lap before it. Repeated lockups, wheelspin and bottoming of one wheel
on one stretch of track come first; a lap without one (bottoming aside) may be told of a braking point that it and the lap before share, or
else of the corner where it lost most time. All of it is windows over laps and joins of samples with the corners asked about; only the
two-lap silence between equal notes is a scan.

Tables: laps (session, lap, number, time_ms, counts), samples (lap, dist, t, speed, brake; dist rising), events (lap, n, type, severity, start_dist, wheels),
corners (lap, n, entry_dist, exit_dist) of every lap that may be a reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.sources.scratch import staged

from . import align, windows

# Laps of the windows; least hits; stretch of track (m); gates of severity; reach to a corner (m); silence (laps).
EVENT_LAPS, BRAKE_LAPS, LEAST_HITS, BUCKET_M, LOCKUP_SLIP, SPIN_SLIP, CORNER_REACH_M, SILENCE_LAPS = 3, 2, 3, 120.0, 0.8, 1.25, 250.0, 2
# Metres before an entry in which braking counts, pedal (%), least difference of braking points (m), least loss (ms), step of the delta (m).
BRAKE_SEARCH_M, BRAKE_PCT, BRAKE_LEAST_M, LOSS_LEAST_MS, DELTA_STEP_M = 250.0, 20.0, 10.0, 150.0, 5.0
SHARE_M = 100.0  # buckets by which samples meet corners


def replay_order(laps: DataFrame, samples: DataFrame) -> DataFrame:
    """laps with seq, ``full`` (counts and has samples), ref and best_ms (the fastest full lap before, the earlier of equals) and the laps of the braking window."""
    laps = laps.select("session", "lap", "number", "time_ms", "counts")
    laps = laps.join(samples.select(F.col("lap").alias("_l")).distinct(), F.col("lap") == F.col("_l"), "left")
    by = windows.ordered(["session"], "number", "lap")
    laps = laps.withColumns({"seq": F.row_number().over(by), "full": F.col("counts") & F.col("_l").isNotNull()})
    best = F.min(F.when(F.col("full"), F.struct("time_ms", "seq", "lap"))).over(windows.before(["session"], "seq"))
    near = F.collect_list(F.struct("lap", "full")).over(windows.ordered(["session"], "seq").rowsBetween(1 - BRAKE_LAPS, 0))
    laps = laps.withColumns({"best": best, "near": near})
    steady = (F.size("near") == BRAKE_LAPS) & F.forall("near", lambda x: x["full"])
    return laps.select("session", "lap", "number", "time_ms", "counts", "seq", F.col("best.lap").alias("ref"), F.col("best.time_ms").alias("best_ms"), F.when(steady, F.transform("near", lambda x: x["lap"])).alias("recent"))


def corner_measures(samples: DataFrame, asked: DataFrame) -> DataFrame:
    """(lap, entry, exit, brake_at, slowest): first braking on the approach, and least speed inside, for each (lap, entry, exit) asked about."""
    bucket = lambda c: F.floor(c / SHARE_M).cast("long")
    spread = asked.distinct().withColumn("_b", F.explode(F.sequence(bucket(F.col("entry") - BRAKE_SEARCH_M), bucket(F.col("exit")))))
    met = spread.join(samples.withColumn("_b", bucket(F.col("dist"))), ["lap", "_b"])
    braking = (F.col("dist") >= F.col("entry") - BRAKE_SEARCH_M) & (F.col("dist") <= F.col("entry")) & (F.col("brake") >= BRAKE_PCT)
    return met.groupBy("lap", "entry", "exit").agg(F.min(F.when(braking, F.col("dist"))).alias("brake_at"), F.min(F.when(F.col("dist").between(F.col("entry"), F.col("exit")), F.col("speed"))).alias("slowest"))


def _clock_at(samples: DataFrame, points: DataFrame) -> DataFrame:
    """(lap, at, t): the clock of laps at grid places."""
    out = align.interpolate(samples.select("lap", "dist", "t"), points.distinct().withColumn("dist", F.col("at") * DELTA_STEP_M), ["lap"], "dist", ["t"])
    return out.select("lap", F.round(F.col("dist") / DELTA_STEP_M).cast("long").alias("at"), "t")


def corner_differences(laps: DataFrame, samples: DataFrame, corners: DataFrame) -> DataFrame:
    """For every judged lap and corner of its reference that does not cross the line: loss_ms over the corner, braking points of its recent laps against the reference's, apex speed difference."""
    who = laps.where("counts and ref is not null").select("session", "lap", "number", "seq", "ref", "time_ms", "best_ms", "recent")
    at = corners.select(F.col("lap").alias("ref"), "n", F.col("entry_dist").cast("double").alias("entry"), F.col("exit_dist").cast("double").alias("exit")).where("entry < exit")
    pairs = staged(who.join(at, "ref"), "lap-corners")
    others = F.array_union(F.coalesce("recent", F.array().cast("array<long>")), F.array(F.col("lap").cast("long"), F.col("ref").cast("long")))
    measured = staged(corner_measures(samples, pairs.select(F.explode(others).alias("lap"), "entry", "exit")), "measures")
    m = lambda name: measured.select(F.col("lap").alias(f"_{name}"), F.col("entry").alias("_en"), F.col("exit").alias("_ex"), F.col("brake_at").alias(f"{name}_brake"), F.col("slowest").alias(f"{name}_slow"))
    same = (F.col("entry") == F.col("_en")) & (F.col("exit") == F.col("_ex"))
    out = pairs.join(m("own"), (F.col("lap") == F.col("_own")) & same, "left").drop("_own", "_en", "_ex")
    out = out.join(m("ref"), (F.col("ref") == F.col("_ref")) & same, "left").drop("_ref", "_en", "_ex")
    each = pairs.where("recent is not null").select("lap", "n", "entry", "exit", F.explode("recent").alias("who")).join(m("near"), (F.col("who") == F.col("_near")) & same, "left")
    near = each.groupBy("lap", "n").agg(F.min("near_brake").alias("least"), F.max("near_brake").alias("most"), F.count("near_brake").alias("braked"))
    out = out.join(near.withColumnRenamed("lap", "_l").withColumnRenamed("n", "_n"), (F.col("lap") == F.col("_l")) & (F.col("n") == F.col("_n")), "left").drop("_l", "_n")
    # the delta runs over the shorter of both laps
    ends = samples.groupBy("lap").agg(F.max("dist").alias("end"))
    end = lambda name: ends.select(F.col("lap").alias(f"_{name}"), F.col("end").alias(f"{name}_end"))
    out = out.join(end("a"), F.col("lap") == F.col("_a"), "left").join(end("b"), F.col("ref") == F.col("_b")).drop("_a", "_b")
    last = F.floor(F.least("a_end", "b_end") / DELTA_STEP_M)
    place = lambda c: F.least(last, F.greatest(F.lit(0), F.bround(F.col(c) / DELTA_STEP_M))).cast("long")
    out = staged(out.withColumns({"at_entry": place("entry"), "at_exit": place("exit"), "grid": last}), "corner-pairs")
    points = out.where("a_end is not null").select(F.explode(F.array(*[F.struct(F.col(w).alias("lap"), F.col(c).alias("at")) for w in ("lap", "ref") for c in ("at_entry", "at_exit")])).alias("p")).select("p.*")
    clock = staged(_clock_at(samples, points), "clocks")
    for w in ("lap", "ref"):
        for c in ("entry", "exit"):
            there = clock.select(F.col("lap").alias("_l"), F.col("at").alias("_at"), F.col("t").alias(f"{w}_{c}_t"))
            out = out.join(there, (F.col(w) == F.col("_l")) & (F.col(f"at_{c}") == F.col("_at")), "left").drop("_l", "_at")
    delta = lambda c: F.round((F.col(f"lap_{c}_t") - F.col(f"ref_{c}_t")) * 1000, 1)
    return out.withColumns({
        "loss_ms": F.when(F.col("grid") >= 1, delta("exit") - delta("entry")), "brake_delta": F.col("own_brake") - F.col("ref_brake"), "apex_delta": F.col("own_slow") - F.col("ref_slow"),
        # of braking points all before or all behind the reference's, the nearest to it
        "habit": F.when(F.col("braked") == BRAKE_LAPS, F.when(F.col("most") < F.col("ref_brake"), F.col("most") - F.col("ref_brake")).when(F.col("least") > F.col("ref_brake"), F.col("least") - F.col("ref_brake"))),
    })


def repeated_events(laps: DataFrame, events: DataFrame, corners: DataFrame) -> DataFrame:
    """(session, lap, seq, number, type, wheel, bucket, hits, dist, corner): the most frequent wheel and stretch of the last three laps, if it was not told in the lap before."""
    loud = events.where((F.col("type") == "bottoming") | ((F.col("type") == "lockup") & (F.col("severity") <= LOCKUP_SLIP)) | ((F.col("type") == "wheelspin") & (F.col("severity") >= SPIN_SLIP)))
    loud = loud.select("lap", "n", "type", "start_dist", F.posexplode("wheels").alias("nth", "wheel")).withColumn("bucket", F.floor(F.col("start_dist") / BUCKET_M).cast("long"))
    held = loud.join(laps.select("session", "lap", F.col("seq").alias("of")), "lap").withColumn("age", F.explode(F.array(*[F.lit(a) for a in range(EVENT_LAPS)])))
    held = held.withColumn("seq", F.col("of") + F.col("age"))
    hits = held.groupBy("session", "seq", "type", "wheel", "bucket").agg(F.count("*").alias("hits"), F.avg("start_dist").alias("dist"), F.min(F.struct("age", "n", "nth")).alias("first")).where(F.col("hits") >= LEAST_HITS)
    told = laps.where("counts").select("session", "seq", "lap", "number", "ref").join(hits, ["session", "seq"])
    told = told.withColumn("r", F.row_number().over(Window.partitionBy("session", "seq").orderBy(F.col("hits").desc(), "first"))).where("r = 1")
    key = ["session", "type", "wheel", "bucket"]
    told = staged(told.withColumn("row", F.row_number().over(windows.ordered(key, "seq")) - 1).drop("r", "first"), "repeated")
    kept = windows.thin(told, key, "seq", "number", SILENCE_LAPS).select(*key, "row")
    told = told.join(kept, [*key, "row"])
    c = corners.select(F.col("lap").alias("ref"), F.col("n").alias("c"), F.col("entry_dist").alias("en"), F.col("exit_dist").alias("ex"))
    near = told.select("session", "seq", "ref", "type", "dist").join(c, "ref")
    inside = F.when(F.col("en") <= F.col("ex"), F.col("dist").between(F.col("en"), F.col("ex"))).otherwise((F.col("dist") >= F.col("en")) | (F.col("dist") <= F.col("ex")))
    gap = F.when(F.col("type") == "wheelspin", F.col("dist") - F.col("ex")).otherwise(F.col("en") - F.col("dist"))
    reach = (gap >= 0) & (gap < CORNER_REACH_M)
    near = near.groupBy("session", "seq").agg(F.coalesce(F.min(F.when(inside, F.col("c"))), F.min(F.when(reach, F.struct(gap.alias("g"), "c")))["c"]).alias("corner"))
    return told.join(near, ["session", "seq"], "left").drop("row", "ref")


def notes(laps: DataFrame, samples: DataFrame, events: DataFrame, corners: DataFrame) -> DataFrame:
    """(session, lap, number, type, corner, wheel, hits, delta_m, loss_ms, brake_delta_m, apex_delta_kmh): what each lap is told, every note once a session."""
    ordered = staged(replay_order(laps, samples), "laps-in-order")
    repeated = staged(repeated_events(ordered, events, corners), "repeated-events")
    kind = F.when(F.col("type") == "lockup", "repeated_lockups").when(F.col("type") == "bottoming", "repeated_bottoming").otherwise("repeated_wheelspin")
    none = lambda t: F.lit(None).cast(t)

    def row(df: DataFrame, type_: Column, key: Column, **values: Column) -> DataFrame:
        columns = {"corner": "int", "wheel": "string", "hits": "long", "delta_m": "double", "loss_ms": "long", "brake_delta_m": "double", "apex_delta_kmh": "double"}
        return df.select("session", "seq", "lap", "number", type_.alias("type"), key.alias("key"), *[values.get(c, none(t)).cast(t).alias(c) for c, t in columns.items()])

    first = row(repeated, kind, F.concat_ws(":", "type", "wheel", "bucket"), corner=F.col("corner"), wheel=F.col("wheel"), hits=F.col("hits"))
    # driving notes take the one place of a lap, a note on ride height does not
    taken = repeated.where("type <> 'bottoming'").select("lap")
    judged = staged(corner_differences(ordered.join(taken, "lap", "left_anti"), samples, corners), "corner-differences")
    pick = lambda df, size: df.withColumn("r", F.row_number().over(Window.partitionBy("lap").orderBy(size.desc(), "n"))).where("r = 1")
    habits = pick(judged.where(F.abs("habit") >= BRAKE_LEAST_M), F.abs("habit"))
    braking = row(habits, F.when(F.col("habit") < 0, "braking_early").otherwise("braking_late"), F.concat(F.lit("braking:"), F.col("n")), corner=F.col("n"), delta_m=F.round("habit", 1))
    lost = judged.where((F.col("time_ms") > F.col("best_ms")) & (F.col("loss_ms") > 0)).join(habits.select("lap"), "lap", "left_anti")
    lost = pick(lost, F.col("loss_ms")).where(F.col("loss_ms") >= LOSS_LEAST_MS)
    loss = row(lost, F.lit("corner_time_loss"), F.concat(F.lit("loss:"), F.col("number")), corner=F.col("n"), loss_ms=F.bround("loss_ms"), brake_delta_m=F.round("brake_delta", 1), apex_delta_kmh=F.round("apex_delta", 1))
    said = first.unionByName(braking).unionByName(loss)
    once = F.row_number().over(Window.partitionBy("session", "key").orderBy("seq"))
    return said.withColumn("r", once).where("r = 1").drop("r", "key", "seq")
