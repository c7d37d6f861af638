"""Queries of the lap life, identification, engineer, survey and table-change operators, registered beside the catalogue's.

The driver's tables stand in as in the catalogue: events are packets of a console, orders laps of a
session (customer), lineitem the samples of a lap, suppliers circuits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.functions import units
from lapforge.operators import calibration, engineer, identify, lifecycle, salvage, survey, tables

from .catalog import EVENTS, cents, events, query, table

_LAPS = "(SELECT o_custkey, o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS time_c, o_orderkey % 7 AS number FROM orders)"


def _laps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", cents("o_totalprice").alias("time_c"), (F.col("o_orderkey") % 7).alias("number"))


# --- the life of a lap -------------------------------------------------------------


@query(f"""SELECT user_id, segment, coalesce(min(head), max(event_id)) AS "first", coalesce(max(tail), max(event_id)) AS "last" FROM (
  SELECT *, CASE WHEN lead(k) OVER w > k THEN event_id END AS head, CASE WHEN k > lag(k) OVER w THEN event_id END AS tail FROM (
    SELECT *, CAST(sum(CASE WHEN q IS NULL OR k + 25 < q THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS segment FROM (
      SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM {EVENTS}))
  WINDOW w AS (PARTITION BY user_id, segment ORDER BY event_id)) GROUP BY user_id, segment""")
def clock_segments(spark, d):
    return lifecycle.clock_segments(events(spark, d), ["user_id"], "event_id", "k", 25)


@query(f"""SELECT user_id, CAST(count(drift) AS BIGINT) AS samples, coalesce(arg_max(drift, CASE WHEN drift IS NOT NULL THEN event_id END), 0) AS drift, coalesce(max(abs(drift)), 0) AS worst FROM (
  SELECT user_id, event_id, CASE WHEN row_number() OVER w > 1 THEN (v - k) - first_value(v - k) OVER w END AS drift FROM (
    SELECT *, sum(CASE WHEN k < q THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS anchor FROM (
      SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM {EVENTS}))
  WINDOW w AS (PARTITION BY user_id, anchor ORDER BY event_id)) GROUP BY user_id""")
def clock_drift(spark, d):
    return lifecycle.clock_drift(events(spark, d), ["user_id"], "event_id", "v", "k")


_VERDICT = f"""(SELECT *, CAST(CASE WHEN len(near) < 3 THEN list_max(near) ELSE list_median(near) END AS DOUBLE) AS reference FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total,
    list(time_c) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS near FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey, number ORDER BY o_orderkey DESC) AS newest FROM {_LAPS}) WHERE newest = 1))"""


@query(f"""SELECT o_orderkey, reference, confirmed, counts, min(CASE WHEN counts THEN time_c END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM (
  SELECT *, n >= 3 AND reference > 0 AND len(list_filter(near, lambda x: x >= reference * 0.97::DOUBLE)) >= 2 AS confirmed,
    total = 1 OR time_c >= last_value(reference) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * CASE WHEN total >= 3 THEN 0.97::DOUBLE ELSE 0.93::DOUBLE END AS counts FROM {_VERDICT})""")
def span_verdicts(spark, d):
    out = lifecycle.span_verdicts(_laps(spark, d), "o_custkey", "o_orderkey", "number", "time_c", "time_c")
    return out.select("o_orderkey", "reference", "confirmed", "counts", "best_before")


_CROSS = f"""(SELECT user_id, event_id, lap, round(x, 3) AS x, round(z, 3) AS z, round(vx / norm, 5) + 0.0::DOUBLE AS hx, round(vz / norm, 5) + 0.0::DOUBLE AS hz FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM (
  SELECT *, sqrt(vx * vx + vz * vz) AS norm FROM (SELECT user_id, event_id, k // 20 AS lap, lag(k // 20) OVER (PARTITION BY user_id ORDER BY event_id) AS q, k * 10 AS speed,
    CAST(event_id % 31 AS DOUBLE) AS x, CAST(k % 13 AS DOUBLE) AS z, CAST(k % 7 - 3 AS DOUBLE) AS vx, CAST(event_id % 5 AS DOUBLE) AS vz FROM {EVENTS}))
  WHERE q >= 1 AND lap = q + 1 AND speed >= 5 AND norm > 0) WHERE r <= 50)"""


def _crossings(spark, d):
    num = lambda c: F.expr(c).cast("double")
    e = events(spark, d).select("user_id", "event_id", F.floor(F.col("k") / 20).alias("lap"), (F.col("k") * 10).alias("speed"), num("event_id % 31").alias("px"), num("k % 13").alias("pz"), num("k % 7 - 3").alias("vx"), num("event_id % 5").alias("vz"))
    return lifecycle.finish_crossings(e, ["user_id"], "event_id", "lap", "speed", "px", "pz", "vx", "vz")


@query(f"SELECT user_id, event_id, lap, x, z, hx, hz FROM {_CROSS}")
def finish_crossings(spark, d):
    return _crossings(spark, d)


@query(f"""SELECT user_id, round(mx, 2) AS x, round(mz, 2) AS z, round(CASE WHEN sqrt(sx * sx + sz * sz) < 0.1 THEN ox ELSE sx / sqrt(sx * sx + sz * sz) END, 5) AS hx,
  round(CASE WHEN sqrt(sx * sx + sz * sz) < 0.1 THEN oz ELSE sz / sqrt(sx * sx + sz * sz) END, 5) AS hz, crossings, round(far, 1) AS spread, crossings >= 2 AND far <= 15 AS confident FROM (
  SELECT user_id, any_value(mx) AS mx, any_value(mz) AS mz, CAST(count(*) AS BIGINT) AS crossings, max(sqrt((x - mx) * (x - mx) + (z - mz) * (z - mz))) AS far, sum(hx) AS sx, sum(hz) AS sz, arg_min(hx, event_id) AS ox, arg_min(hz, event_id) AS oz FROM (
    SELECT *, avg(x) OVER (PARTITION BY user_id) AS mx, avg(z) OVER (PARTITION BY user_id) AS mz FROM {_CROSS}) GROUP BY user_id)""")
def finish_line(spark, d):
    return lifecycle.finish_line(_crossings(spark, d), ["user_id"], "event_id")


def _packets(spark, d):
    """events as packets with a counter that steps on, falls back and jumps, loading gaps, pauses and reported times."""
    num = lambda c, t="long": F.expr(c).cast(t)
    return events(spark, d).select(
        "user_id", "event_id", num("event_id div 100").alias("packet_id"), num("event_id div 4000 % 2", "int").alias("car_id"), num("CASE WHEN event_id div 1500 % 5 = 4 THEN 6 ELSE event_id div 1500 % 5 END", "int").alias("current_lap"),
        F.lit(0).alias("total_laps"), F.expr("k % 31 <> 5").alias("on_track"), F.expr("k % 29 = 3").alias("paused"), F.expr("k % 25 = 0").alias("loading"), num("v % 1500 - 300").alias("last_ms"), F.lit(-1).alias("best_ms"),
        F.expr("CASE WHEN user_id % 2 = 0 THEN cast(event_id % 1500 AS long) END").alias("clock_ms"), num("k", "double").alias("speed"), num("100 - event_id / 1000", "double").alias("fuel"),
    )


@query()
def lap_salvage(spark, d):
    """Completed and salvaged laps; the stream of the same name gives the same rows (tests)."""
    return salvage.lap_stream(_packets(spark, d), "user_id", "event_id", 5)


@query(f"""WITH e AS (SELECT * FROM {EVENTS}), s AS (SELECT user_id, segment, coalesce(min(head), max(event_id)) AS a, coalesce(max(tail), max(event_id)) AS b FROM (
    SELECT *, CASE WHEN lead(k) OVER w > k THEN event_id END AS head, CASE WHEN k > lag(k) OVER w THEN event_id END AS tail FROM (
      SELECT *, CAST(sum(CASE WHEN q IS NULL OR k + 25 < q THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS segment FROM (
        SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM e)) WINDOW w AS (PARTITION BY user_id, segment ORDER BY event_id)) GROUP BY user_id, segment),
  t AS (SELECT user_id, arg_max(v, event_id) AS l, max(v) AS m, min(v) AS n FROM e GROUP BY user_id),
  c AS (SELECT user_id, segment, (b - a) * 17 AS took, list_filter([l, m // 3, n, m // 2], lambda x: x > 0 AND abs(x - (b - a) * 17) <= greatest(500, (b - a) * 17 * 0.005::DOUBLE)) AS hit FROM s JOIN t USING (user_id))
SELECT user_id, segment, took, hit[1] AS matched FROM c WHERE len(hit) > 0""")
def time_match(spark, d):
    """Stretches of a clock whose time one of the reported times agrees with."""
    e = events(spark, d)
    stretches = lifecycle.clock_segments(e, ["user_id"], "event_id", "k", 25)
    times = e.groupBy("user_id").agg(F.max_by("v", "event_id").alias("l"), F.max("v").alias("m"), F.min("v").alias("n"))
    reported = F.array("l", F.expr("m div 3"), "n", F.expr("m div 2"))
    out = stretches.join(times, "user_id").withColumn("took", (F.col("last") - F.col("first")) * 17)
    return out.withColumn("matched", salvage.matched_time(reported, F.col("took"))).where("matched is not null").select("user_id", "segment", "took", "matched")


# --- identification and calibration ------------------------------------------------

_SAMPLES = f"""(SELECT user_id, event_id, CAST(k AS DOUBLE) AS x, CAST(event_id % 61 AS DOUBLE) AS z, CAST(40 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS dist FROM {EVENTS})"""


def _samples(spark, d):
    from lapforge.operators.windows import ordered

    place = F.row_number().over(ordered(["user_id"], "event_id"))
    return events(spark, d).select("user_id", "event_id", F.col("k").cast("double").alias("x"), (F.col("event_id") % 61).cast("double").alias("z"), (40 * place).cast("double").alias("dist"))


@query(f"""SELECT user_id, arg_max(dist, event_id) AS length, min(x) AS min_x, max(x) AS max_x, min(z) AS min_z, max(z) AS max_z,
  count(*) >= 2 AND arg_max(dist, event_id) >= 400 AND sqrt(pow(arg_max(x, event_id) - arg_min(x, event_id), 2) + pow(arg_max(z, event_id) - arg_min(z, event_id), 2)) <= greatest(60.0, arg_max(dist, event_id) * 0.05) AS whole
  FROM {_SAMPLES} GROUP BY user_id""")
def lap_signature(spark, d):
    return identify.signatures(_samples(spark, d), ["user_id"], "event_id", "dist", "x", "z")


@query("""SELECT l_orderkey, l_suppkey, coverage FROM (SELECT *, row_number() OVER w AS r, coalesce(lead(coverage) OVER w, 0) AS nxt FROM (
  SELECT l_orderkey, l_suppkey, max(l_quantity) / 50 AS coverage FROM lineitem GROUP BY l_orderkey, l_suppkey) WINDOW w AS (PARTITION BY l_orderkey ORDER BY coverage DESC, l_suppkey DESC))
  WHERE r = 1 AND coverage >= 0.6::DOUBLE AND coverage - nxt >= 0.25::DOUBLE""")
def match_decision(spark, d):
    scores = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg((F.max("l_quantity") / 50).alias("coverage"))
    return identify.match_decision(scores, ["l_orderkey"], "l_suppkey", "coverage")


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {_SAMPLES}),
  p AS (SELECT s_suppkey // 100 AS track, row_number() OVER (PARTITION BY s_suppkey // 100 ORDER BY s_suppkey) - 1 AS j, CAST(s_suppkey * 37 % 100 AS DOUBLE) AS px, CAST(s_suppkey * 11 % 61 AS DOUBLE) AS pz, count(*) OVER (PARTITION BY s_suppkey // 100) AS total FROM supplier),
  m AS (SELECT user_id, i, any_value(total) AS total, arg_min(j, {{'d': (px - x) * (px - x) + (pz - z) * (pz - z), 'j': j}}) AS j FROM s, p
    WHERE track = user_id % 10 AND n >= 2 AND i % greatest(1, n // 80) = 0 AND total >= 8 AND abs(floor(px / 20) - floor(x / 20)) <= 1 AND abs(floor(pz / 20) - floor(z / 20)) <= 1 GROUP BY user_id, i),
  t AS (SELECT user_id, ((j - lag(j) OVER (PARTITION BY user_id ORDER BY i)) % total + total) % total AS step, total FROM m),
  a AS (SELECT user_id, count(CASE WHEN step > 0 AND step < total / 2 THEN 1 END) AS f, count(CASE WHEN step >= total / 2 THEN 1 END) AS b FROM t GROUP BY user_id)
  SELECT u.user_id, coalesce(CASE WHEN f + b > 0 THEN (f - b) / (f + b) ELSE 0.0 END, 0.0) AS direction FROM (SELECT DISTINCT user_id FROM s) u LEFT JOIN a ON a.user_id = u.user_id""")
def travel_direction(spark, d):
    from pyspark.sql import Window

    path = table(spark, d, "supplier").withColumn("track", F.floor(F.col("s_suppkey") / 100))  # a circuit for every hundred
    place = (F.row_number().over(Window.partitionBy("track").orderBy("s_suppkey")) - 1).cast("long")
    path = path.select("track", place.alias("j"), (F.col("s_suppkey") * 37 % 100).cast("double").alias("x"), (F.col("s_suppkey") * 11 % 61).cast("double").alias("z"))
    return identify.travel_direction(_samples(spark, d).withColumn("track", F.col("user_id") % 10), path, ["user_id"], "event_id", "track")


_DRIVE = f"""(SELECT user_id, event_id, CAST(k AS DOUBLE) AS pos_x, CAST(event_id % 61 AS DOUBLE) AS pos_z, 3.0::DOUBLE * r AS dist, 0.125::DOUBLE * r AS t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM {EVENTS}))"""


@query(f"""SELECT user_id, event_id, round(CASE WHEN n >= 5 AND lo.d < dist AND hi.d > dist AND hi.t > lo.t THEN
    atan2(ax * bz - az * bx + 0.0, ax * bx + az * bz) / ((hi.t - lo.t) / 2) ELSE 0.0 END, 6) AS heading_rate FROM (
  SELECT *, CASE WHEN pos_x = lo.x AND pos_z = lo.z THEN 1.0 ELSE pos_x - lo.x END AS ax, pos_z - lo.z AS az, CASE WHEN hi.x = pos_x AND hi.z = pos_z THEN 1.0 ELSE hi.x - pos_x END AS bx, hi.z - pos_z AS bz FROM (
    SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
      first_value({{'d': dist, 't': t, 'x': pos_x, 'z': pos_z}}) OVER (PARTITION BY user_id ORDER BY dist RANGE BETWEEN 8 PRECEDING AND CURRENT ROW) AS lo,
      coalesce(first_value({{'d': dist, 't': t, 'x': pos_x, 'z': pos_z}}) OVER (PARTITION BY user_id ORDER BY dist RANGE BETWEEN 8 FOLLOWING AND UNBOUNDED FOLLOWING),
        last_value({{'d': dist, 't': t, 'x': pos_x, 'z': pos_z}}) OVER (PARTITION BY user_id ORDER BY dist ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS hi
    FROM {_DRIVE}))""")
def heading_rate(spark, d):
    s = _samples(spark, d).select("user_id", "event_id", F.col("x").alias("pos_x"), F.col("z").alias("pos_z"), (F.col("dist") / 40 * 3.0).alias("dist"), (F.col("dist") / 40 * 0.125).alias("t"))
    return calibration.heading_rate(s, ["user_id"], "event_id").select("user_id", "event_id", F.round("heading_rate", 6).alias("heading_rate"))


# --- the engineer ------------------------------------------------------------------

_COUNTED = f"(SELECT *, time_c // 1000 AS ms FROM {_LAPS} WHERE o_orderstatus <> 'P')"


@query(f"""SELECT o_custkey, o_orderkey, round(average, 6) AS average, best, spell, CAST(floor((average - best) / 500) AS INTEGER) AS severity FROM (
  SELECT *, CAST(count(CASE WHEN sign = 0 AND was = 1 THEN 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS spell FROM (
    SELECT *, last_value(sign IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM (
      SELECT *, CASE WHEN n >= 4 AND (least3 - best < 400 OR average - best < 400) THEN 0 WHEN n >= 4 AND average - best >= 800 THEN 1 END AS sign FROM (
        SELECT *, count(*) OVER w AS n, min(ms) OVER w AS best, avg(ms) OVER v AS average, min(ms) OVER v AS least3 FROM {_COUNTED}
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))))) WHERE sign = 1""")
def pace_drops(spark, d):
    laps = _laps(spark, d).withColumn("ms", F.floor(F.col("time_c") / 1000))
    return engineer.pace_drops(laps, "o_custkey", "o_orderkey", "ms", F.col("o_orderstatus") != "P").withColumn("average", F.round("average", 6))


@query(f"""SELECT o_custkey, o_orderkey, ms, CASE WHEN delta < 0 THEN 'personal_best' ELSE 'lap_time' END AS event_type, delta, abs(delta) >= 50 AS told FROM (
  SELECT *, coalesce(ms - min(ms) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS delta FROM {_COUNTED} WHERE ms > 0)""")
def lap_callouts(spark, d):
    laps = _laps(spark, d).withColumn("ms", F.floor(F.col("time_c") / 1000))
    return engineer.lap_callouts(laps, "o_custkey", "o_orderkey", "ms", F.col("o_orderstatus") != "P")


@query(f"""SELECT * FROM (SELECT user_id, 'final_lap' AS event_type, min(CASE WHEN k // 10 = 9 THEN event_id END) AS "at" FROM {EVENTS} WHERE k // 10 > 0 GROUP BY user_id UNION ALL
  SELECT user_id, 'race_halfway', min(CASE WHEN k // 10 > 4.5 AND k // 10 < 9 THEN event_id END) FROM {EVENTS} WHERE k // 10 > 0 GROUP BY user_id) WHERE "at" IS NOT NULL""")
def race_marks(spark, d):
    e = events(spark, d).withColumns({"lap": F.floor(F.col("k") / 10), "laps": F.lit(9)})
    return engineer.race_marks(e, ["user_id"], "event_id", "lap", "laps")


@query("""SELECT l_orderkey, CASE WHEN abs(axle) >= abs(side) THEN 'front_rear' ELSE 'left_right' END AS axis,
  CASE WHEN abs(axle) >= abs(side) THEN CASE WHEN axle > 0 THEN 'rear' ELSE 'front' END ELSE CASE WHEN side > 0 THEN 'left' ELSE 'right' END END AS hotter,
  CAST(round_even(greatest(abs(axle), abs(side)), 0) AS BIGINT) AS degrees FROM (
  SELECT l_orderkey, (rl + rr) / 2 - (fl + fr) / 2 AS axle, (fl + rl) / 2 - (fr + rr) / 2 AS side FROM (
    SELECT l_orderkey, avg(l_quantity) AS fl, avg(l_linenumber * 10) AS fr, avg(l_partkey % 60) AS rl, avg(l_suppkey % 60) AS rr FROM lineitem GROUP BY l_orderkey)) WHERE greatest(abs(axle), abs(side)) >= 8""")
def tyre_balance(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("fl"), (F.col("l_linenumber") * 10).alias("fr"), (F.col("l_partkey") % 60).alias("rl"), (F.col("l_suppkey") % 60).alias("rr"))
    return engineer.tyre_balance(s, ["l_orderkey"], "fl", "fr", "rl", "rr")


@query(f"""SELECT user_id, event_id AS "at" FROM (SELECT *, lag(off) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS nth FROM (
    SELECT *, sum(CASE WHEN off = q THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (
      SELECT *, lag(off) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM (SELECT *, k // 20 >= 3 AND event_id % 10 >= 1 AS off FROM {EVENTS}))))
  WHERE (off AND nth = 2) OR (NOT off AND nth = 3)) WHERE off AND NOT coalesce(was, false)""")
def off_road(spark, d):
    e = events(spark, d).withColumns({"loose": F.floor(F.col("k") / 20), "speed": F.when(F.col("event_id") % 10 >= 1, 20.0).otherwise(1.0)})
    return engineer.off_road(e, ["user_id"], "event_id", "loose", "speed", 2, 3)


@query(f"""SELECT o_custkey, round(burn, 4) AS burn, n, round(level / burn, 4) AS laps_to_empty, CAST(10 + floor(level / burn) AS BIGINT) AS pit_before_lap FROM (
  SELECT o_custkey, any_value(level) AS level, avg(time_c) AS burn, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, max(time_c) OVER (PARTITION BY o_custkey) AS top FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM (SELECT l.*, c.c_nationkey % 3 AS car, 1e9::DOUBLE AS level FROM {_LAPS} l JOIN customer c ON o_custkey = c_custkey)
    WHERE time_c > 0.01 AND number % 3 = car) WHERE r <= 3) WHERE time_c >= 0.5 * top GROUP BY o_custkey)""")
def strategy(spark, d):
    states = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 3).cast("long").alias("car"), F.lit(1e9).alias("fuel_level"), F.lit(10).alias("current_lap"))
    laps = _laps(spark, d).withColumn("car", F.col("number") % 3)
    out = engineer.strategy(states, laps, "o_custkey", ["o_orderkey"], "time_c", "time_c", "car")
    return out.select("o_custkey", F.round("burn", 4).alias("burn"), "n", F.round("laps_to_empty", 4).alias("laps_to_empty"), "pit_before_lap")


@query(f"""SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY rank, rule) - 1 AS INTEGER) AS place, id, severity FROM (
  SELECT event_id, 0 AS rule, 'fuel' AS id, CASE WHEN event_id % 40 < 15 THEN 'critical' ELSE 'warn' END AS severity, CASE WHEN event_id % 40 < 15 THEN 0 ELSE 1 END AS rank FROM {EVENTS} WHERE k % 3 > 0 AND event_id % 40 < 30 UNION ALL
  SELECT event_id, 4, 'oil-pressure', 'critical', 0 FROM {EVENTS} WHERE k % 5 > 0 AND k % 7 - 1 >= 0 AND k % 7 - 1 < 2 AND event_id % 4000 > 2000 UNION ALL
  SELECT event_id, 1 AS rule, 'pit' AS id, 'info' AS severity, 2 AS rank FROM {EVENTS} WHERE k // 10 < 9 AND k // 10 <= 4 + 1 UNION ALL
  SELECT event_id, 2, 'water', CASE WHEN k + 40 > 120 THEN 'critical' ELSE 'warn' END, CASE WHEN k + 40 > 120 THEN 0 ELSE 1 END FROM {EVENTS} WHERE k + 40 > 110 UNION ALL
  SELECT event_id, 3, 'oil-temp', CASE WHEN event_id % 50 + 100 > 140 THEN 'critical' ELSE 'warn' END, CASE WHEN event_id % 50 + 100 > 140 THEN 0 ELSE 1 END FROM {EVENTS} WHERE event_id % 50 + 100 > 130 UNION ALL
  SELECT event_id, 5, 'tires', 'warn', 1 FROM {EVENTS} WHERE event_id % 120 > 110)""")
def frame_alerts(spark, d):
    e = events(spark, d)
    known = lambda c, when: F.when(F.expr(when), F.expr(c)).cast("double")  # noqa: E731  null in some rows
    frames = e.select("event_id", known("event_id % 40 / 10", "k % 3 > 0").alias("laps_to_empty"), F.floor(F.col("k") / 10).alias("pit_before_lap"), F.lit(9).alias("total_laps"), F.lit(4).alias("current_lap"), (F.col("k") + 40).alias("water_temp"), (F.col("event_id") % 50 + 100).alias("oil_temp"), known("k % 7 - 1", "k % 5 > 0").alias("oil_pressure"), (F.col("event_id") % 4000).alias("rpm"), (F.col("event_id") % 120).alias("tyre_max"))
    return engineer.alerts(frames, ["event_id"])


# --- the survey --------------------------------------------------------------------


def _wheels(c: str) -> str:
    return " || ".join(f"substr('TTTTKG', CAST(({c} // {p}) % 6 + 1 AS INTEGER), 1)" for p in (1, 3, 7, 11))


@query(f"""SELECT user_id, event_id, previous, surface, CASE WHEN ((a1 <> b1) OR (a3 <> b3)) AND a2 = 'T' AND b2 = 'T' AND a4 = 'T' AND b4 = 'T' THEN 'L'
    WHEN ((a2 <> b2) OR (a4 <> b4)) AND a1 = 'T' AND b1 = 'T' AND a3 = 'T' AND b3 = 'T' THEN 'R' END AS side FROM (
  SELECT *, previous[1] AS a1, previous[2] AS a2, previous[3] AS a3, previous[4] AS a4, surface[1] AS b1, surface[2] AS b2, surface[3] AS b3, surface[4] AS b4 FROM (
    SELECT *, lag(surface) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM (SELECT user_id, event_id, {_wheels("k")} AS surface FROM {EVENTS}))) WHERE previous <> surface""")
def surface_transitions(spark, d):
    wheel = lambda p: F.substring(F.lit("TTTTKG"), (F.floor(F.col("k") / p) % 6 + 1).cast("int"), F.lit(1))
    e = events(spark, d).select("user_id", "event_id", F.concat(*[wheel(p) for p in (1, 3, 7, 11)]).alias("surface"))
    return survey.surface_transitions(e, ["user_id"], "event_id", "surface")


@query(f"""SELECT place, kind, source, CAST(count(*) + max(claimed - i) AS BIGINT) AS votes, max(run) AS run FROM (
  SELECT *, row_number() OVER (PARTITION BY place, kind, source ORDER BY event_id) AS i FROM (
    SELECT *, max(run) OVER (PARTITION BY place, kind, source ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (
      SELECT event_id, k // 10 AS place, event_type AS kind, user_id % 9 AS source, k AS run, event_id % 5 AS claimed FROM {EVENTS})) WHERE top IS NULL OR run > top) GROUP BY place, kind, source""")
def vote_fold(spark, d):
    return survey.fold_votes(_evidence(spark, d), ["place"], "event_id")


def _evidence(spark, d):
    return events(spark, d).select("event_id", F.floor(F.col("k") / 10).alias("place"), F.col("event_type").alias("kind"), (F.col("user_id") % 9).alias("source"), F.col("k").alias("run"), (F.col("event_id") % 5).alias("claimed"))


@query(f"""WITH f AS (SELECT place, kind, source, count(*) + max(claimed - i) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY place, kind, source ORDER BY event_id) AS i FROM (
    SELECT *, max(run) OVER (PARTITION BY place, kind, source ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (
      SELECT event_id, k // 10 AS place, event_type AS kind, user_id % 9 AS source, k AS run, event_id % 5 AS claimed FROM {EVENTS})) WHERE top IS NULL OR run > top) GROUP BY place, kind, source)
SELECT place, kind, CAST(votes AS BIGINT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY (kind = 'refund' AND place % 2 = 0) DESC, votes DESC, kind) AS r FROM (
  SELECT place, CASE WHEN kind = 'refund' AND place % 2 = 1 THEN 'auto' ELSE kind END AS kind, sum(votes) AS votes FROM f GROUP BY ALL) WHERE votes > 0) WHERE r = 1""")
def kind_resolution(spark, d):
    votes = survey.fold_votes(_evidence(spark, d), ["place"], "event_id")
    kind = F.when((F.col("kind") == "refund") & (F.col("place") % 2 == 1), "auto").otherwise(F.col("kind"))
    return survey.resolve_kinds(votes.withColumn("kind", kind), ["place"], ["refund"], ["add_to_cart", "auto", "click", "error", "login", "logout", "purchase", "refund", "signup", "view"])


@query(f"""SELECT user_id, CASE WHEN count(w) >= 5 THEN round(median(w), 3) END AS width, CAST(count(w) AS BIGINT) AS samples FROM (
  SELECT user_id, CASE WHEN yaw >= 0.15 AND abs(((100 - d) + (100 + d)) / 2 / 100.0 - 1) <= 0.05 AND 2 * d / yaw BETWEEN 0.8 AND 2.4 THEN CAST(2 * d / yaw AS DOUBLE) END AS w FROM (
    SELECT user_id, CAST(k AS DOUBLE) / 100 AS yaw, CAST(event_id % 8 AS DOUBLE) / 8 AS d FROM {EVENTS})) GROUP BY user_id""")
def axle_width(spark, d):
    e = events(spark, d).withColumns({"yaw": F.col("k").cast("double") / 100, "d": (F.col("event_id") % 8).cast("double") / 8})
    e = e.withColumns({"speed": F.lit(100.0), "brake": F.lit(0), "rim_fl": 100 - F.col("d"), "rim_fr": 100 + F.col("d"), "rim_rl": F.lit(100.0), "rim_rr": F.lit(100.0)})
    return survey.axle_width(e, ["user_id"], "event_id", 5).select("user_id", "width", "samples")


@query("""SELECT cell, side, coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y FROM (SELECT l_partkey AS cell, l_linenumber AS side, min(l_quantity) AS x, max(CASE WHEN l_tax > 0.04 THEN l_tax END) AS y FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) a
  FULL OUTER JOIN (SELECT l_partkey AS cell, l_linenumber AS side, min(l_quantity) AS x, max(l_tax) AS y FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL) b USING (cell, side)""")
def edge_merge(spark, d):
    li = table(spark, d, "lineitem").withColumns({"cell": F.col("l_partkey"), "side": F.col("l_linenumber")})
    held = li.where("l_returnflag = 'A'").groupBy("cell", "side").agg(F.min("l_quantity").alias("x"), F.max(F.when(F.col("l_tax") > 0.04, F.col("l_tax"))).alias("y"))
    new = li.where("l_returnflag = 'N'").groupBy("cell", "side").agg(F.min("l_quantity").alias("x"), F.max("l_tax").alias("y"))
    return survey.merge_edges(held, new, ["cell", "side"], ["x"], "y")


# --- changes of tables -------------------------------------------------------------


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey >= 5 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3""")
def replace_subset(spark, d):
    fresh = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"), F.col("c_nationkey").alias("s_nationkey"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return tables.replace_subset(s, F.col("s_nationkey") < 5, fresh).select("s_suppkey", "s_name")


@query("""SELECT o_orderkey, o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS partial FROM orders""")
def partial_flags(spark, d):
    listed = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.flag_outside(table(spark, d, "orders"), listed, ["o_orderkey"], "partial").select("o_orderkey", "partial")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def cascade_delete(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return tables.without(table(spark, d, "orders"), gone, ["o_custkey"]).select("o_orderkey")


@query("""SELECT c_custkey, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, c_name) AS c_name, coalesce(s_nationkey, c_nationkey) AS c_nationkey FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def patch_rows(spark, d):
    changes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("c_name"), F.col("s_nationkey").alias("c_nationkey"))
    return tables.patch(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), changes, "c_custkey", ["c_name", "c_nationkey"])


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, arg_max(o_totalprice, o_orderkey) FROM orders GROUP BY o_custkey""")
def upsert_rows(spark, d):
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("seq"))
    return tables.upsert(table(spark, d, "customer").select("c_custkey", "c_acctbal"), new, ["c_custkey"], "seq")


@query("""SELECT k AS id, CASE WHEN n IS NULL OR s >= n THEN w ELSE v END AS width, CASE WHEN n IS NULL OR s >= n THEN s ELSE n END AS samples FROM (SELECT c_custkey AS k, c_acctbal AS w, c_nationkey AS s FROM customer)
  LEFT JOIN (SELECT s_suppkey AS k2, s_acctbal AS v, s_nationkey AS n FROM supplier) ON k = k2""")
def width_store(spark, d):
    held = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("width"), F.col("c_nationkey").alias("samples"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("width"), F.col("s_nationkey").alias("samples"))
    return tables.better_measured(held, new, "id", "samples")


_CORNERS = "(SELECT o_custkey, CAST(number AS BIGINT) AS corner, min({0}) AS t FROM " + _LAPS + " GROUP BY ALL)"


@query(f"""SELECT o_custkey, corner, t, lost, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY lost DESC NULLS LAST, corner) AS INTEGER) AS place FROM (
  SELECT a.*, a.t - b.t AS lost FROM {_CORNERS.format("time_c")} a LEFT JOIN {_CORNERS.format("CASE WHEN o_orderstatus = 'F' THEN time_c // 2 END")} b USING (o_custkey, corner))""")
def loss_card(spark, d):
    laps = _laps(spark, d).withColumnRenamed("number", "corner")
    focus = laps.groupBy("o_custkey", "corner").agg(F.min("time_c").alias("t"))
    ref = laps.groupBy("o_custkey", "corner").agg(F.min(F.when(F.col("o_orderstatus") == "F", F.floor(F.col("time_c") / 2))).alias("t"))
    return tables.loss_card(focus, ref, ["o_custkey"], "corner", "t")


# --- functions ---------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN ms >= 0 THEN '+' ELSE '−' END || CAST(abs(ms) // 1000 AS VARCHAR) || '.' || lpad(CAST(abs(ms) % 1000 AS VARCHAR), 3, '0') AS delta,
  CASE WHEN ms < 0 THEN '–' WHEN ms >= 3600000 THEN CAST(ms // 3600000 AS VARCHAR) || 'h ' || CAST(ms % 3600000 // 60000 AS VARCHAR) || 'm'
    ELSE CAST(ms // 60000 AS VARCHAR) || 'm ' || CAST(ms % 60000 // 1000 AS VARCHAR) || 's' END AS duration, round(kmh * 0.621371::DOUBLE, 6) AS mph, round(kmh / 0.3048::DOUBLE, 6) AS feet
  FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) - 9000000 AS ms, CAST(o_orderkey % 300 AS DOUBLE) AS kmh FROM orders)""")
def unit_texts(spark, d):
    ms, kmh = cents("o_totalprice") - 9_000_000, (F.col("o_orderkey") % 300).cast("double")
    return table(spark, d, "orders").select("o_orderkey", units.delta_text(ms).alias("delta"), units.duration_text(ms).alias("duration"), F.round(units.shown_speed(kmh, True), 6).alias("mph"), F.round(units.spoken_distance(kmh, True), 6).alias("feet"))


@query("""SELECT c_custkey, sha256(c_name)[1:16] AS digest FROM customer""")
def content_digest(spark, d):
    return table(spark, d, "customer").select("c_custkey", units.digest(F.col("c_name"), 16).alias("digest"))


@query("""SELECT s_suppkey, CAST(gear AS INTEGER) AS gear, round(300 * (0.5 + (s_suppkey % 10)) / (0.5 + (s_suppkey % 10) + 4 - gear), 6) AS speed FROM supplier, (SELECT unnest([1, 2, 3, 4]) AS gear)""")
def gear_speeds(spark, d):
    base = 0.5 + F.col("s_suppkey") % 10
    ratios = F.array(*[(base + 4 - g).cast("double") for g in (1, 2, 3, 4)])
    rows = table(spark, d, "supplier").select("s_suppkey", F.explode(units.gear_speeds(ratios, F.lit(300.0))).alias("g"))
    return rows.select("s_suppkey", F.col("g.gear").cast("int").alias("gear"), F.round("g.speed", 6).alias("speed"))
