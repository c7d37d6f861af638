"""Queries of the lap, chassis and policy operators, registered beside the catalogue's.

Events stand in for the ticks of laps: a lap is a user's events in order, 5 m and an eighth of a second apart; pedals, slips and
suspension follow the event number, so that they hold for stretches.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lapforge.functions import bits, units
from lapforge.operators import coaching, corners, edge_rides, engineer, laps, pairing, survey
from lapforge.operators.windows import ordered
from lapforge.sources.scratch import spread

from .catalog import EVENTS, events, query, table

# The same text in both engines: columns of a tick by event_id (e) and k.
_CHANNELS = {
    "brake": "CASE WHEN e7 % 2 = 1 THEN 60 ELSE 0 END + k % 15",
    "throttle": "CASE WHEN e7 % 2 = 0 THEN 80 ELSE 0 END + k % 20",
    "slip_fl": "CASE WHEN e11 % 3 = 0 THEN 84 + k % 5 ELSE 100 + k % 9 END",
    "slip_fr": "100 + k % 7",
    "slip_rl": "98 + k % 11",
    "slip_rr": "CASE WHEN e11 % 3 = 2 THEN 112 + k % 6 ELSE 101 END",
    "sus_fl": "CASE WHEN e9 % 4 = 0 THEN 100 ELSE k % 50 END",
    "sus_fr": "CASE WHEN e9 % 4 = 1 THEN 100 ELSE k % 60 END",
    "sus_rl": "k",
    "sus_rr": "CASE WHEN e9 % 4 = 3 THEN 99 ELSE k % 20 END",
    "speed": "100 + k",
    "fuel": "200000 - event_id",
}
_DIV = ("e7", 700), ("e9", 900), ("e11", 1100)


def _ticks(spark, d):
    place = F.row_number().over(ordered(["user_id"], "event_id")) - 1
    e = spread(events(spark, d).select("user_id", "event_id", "k"), "user_id")  # few bytes a tick, so tasks of adaptive size would hold many ticks
    e = e.select("user_id", "event_id", "k", place.cast("long").alias("i"), *[F.expr(f"event_id div {n}").alias(c) for c, n in _DIV])
    e = e.select("user_id", "event_id", "i", "k", (5.0 * F.col("i")).alias("dist"), (F.col("i") / 8.0).alias("t"), *[F.expr(v).cast("double").alias(c) for c, v in _CHANNELS.items()])
    return e.withColumns({c: F.col(c) / 100 for c in _CHANNELS if c.startswith("slip")})


_SCALED = ", ".join(f"CAST({v} AS DOUBLE){' / 100' if c.startswith('slip') else ''} AS {c}" for c, v in _CHANNELS.items())
_TICKS = f"""(SELECT user_id, event_id, i, k, 5.0::DOUBLE * i AS dist, i / 8.0::DOUBLE AS t, {_SCALED} FROM (SELECT *, {', '.join(f'event_id // {n} AS {c}' for c, n in _DIV)}, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM {EVENTS}))"""


@query(f"""SELECT user_id, CAST(count(*) AS BIGINT) AS ticks, round(100 * sum(CASE WHEN throttle >= 98 THEN w ELSE 0 END) / sum(w), 6) AS full_throttle_pct, round(100 * sum(CASE WHEN brake >= 98 THEN w ELSE 0 END) / sum(w), 6) AS full_brake_pct,
  round(100 * sum(CASE WHEN throttle = 0 AND brake = 0 THEN w ELSE 0 END) / sum(w), 6) AS coasting_pct, round(100 * sum(CASE WHEN greatest(slip_fl, slip_fr, slip_rl, slip_rr) >= 1.1::DOUBLE THEN w ELSE 0 END) / sum(w), 6) AS tire_spin_pct,
  max(speed) AS max_speed, arg_min(fuel, i) - arg_max(fuel, i) AS fuel_consumed, max(dist) AS length_m FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY user_id) = 1 THEN 1.0 ELSE 0.125 END AS w FROM {_TICKS}) GROUP BY user_id""")
def lap_metrics(spark, d):
    out = laps.metrics(_ticks(spark, d), ["user_id"])
    return out.select("user_id", "ticks", *[F.round(c, 6).alias(c) for c in ("full_throttle_pct", "full_brake_pct", "coasting_pct", "tire_spin_pct")], "max_speed", "fuel_consumed", "length_m")


def _islands(active: str, least: int, keys: str = "user_id", source: str = "t") -> str:
    """SQL of (keys, first, last, nth): runs of consecutive rows where a condition holds."""
    return f"""(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY "first") AS nth FROM (SELECT {keys}, min(i) AS "first", max(i) AS "last" FROM (
      SELECT *, i - row_number() OVER (PARTITION BY {keys} ORDER BY i) AS island FROM {source} WHERE {active}) GROUP BY {keys}, island HAVING count(*) >= {least}))"""


_LOW, _HIGH = "least(slip_fl, slip_fr, slip_rl, slip_rr)", "greatest(slip_fl, slip_fr, slip_rl, slip_rr)"
_LOCK, _SPIN = f"brake >= 20 AND {_LOW} < 0.9::DOUBLE", f"throttle >= 40 AND {_HIGH} > 1.1::DOUBLE"


@query(f"""WITH t AS (SELECT * FROM {_TICKS}), l AS {_islands(_LOCK, 2)}, s AS {_islands(_SPIN, 2)}
SELECT l.user_id, l."first", l."last", 'lockup' AS type, min(dist) AS start_dist, max(dist) AS end_dist, min({_LOW}) AS severity FROM l JOIN t ON t.user_id = l.user_id AND i BETWEEN l."first" AND l."last" WHERE nth <= 40 GROUP BY ALL
UNION ALL SELECT s.user_id, s."first", s."last", 'wheelspin', min(dist), max(dist), max({_HIGH}) FROM s JOIN t ON t.user_id = s.user_id AND i BETWEEN s."first" AND s."last" WHERE nth <= 40 GROUP BY ALL""")
def slip_events(spark, d):
    return laps.slip_events(_ticks(spark, d), ["user_id"], 2)


_WHEEL_ROWS = " UNION ALL ".join(f"SELECT user_id, i, {n} AS n, '{w}' AS wheel, sus_{w} AS h FROM t" for n, w in enumerate(("fl", "fr", "rl", "rr")))


@query(f"""WITH t AS (SELECT * FROM {_TICKS}), h AS (SELECT *, min(h) OVER (PARTITION BY user_id, wheel) AS lo, max(h) OVER (PARTITION BY user_id, wheel) AS hi,
    h - (lag(h, 2) OVER (PARTITION BY user_id, wheel ORDER BY i) + lead(h, 2) OVER (PARTITION BY user_id, wheel ORDER BY i)) / 2 AS excess FROM ({_WHEEL_ROWS})),
  v AS (SELECT * FROM h WHERE hi > lo), b AS {_islands("h >= lo + 0.98::DOUBLE * (hi - lo)", 3, "user_id, wheel", "v")}
SELECT user_id, 'bottoming' AS type, wheel, CAST("first" AS BIGINT) AS "first", CAST("last" AS BIGINT) AS "last" FROM b
UNION ALL SELECT user_id, 'kerb', wheel, CAST(i AS BIGINT), CAST(i AS BIGINT) FROM v WHERE excess > 0.35::DOUBLE * (hi - lo)""")
def suspension_events(spark, d):
    return laps.suspension_events(_ticks(spark, d), ["user_id"])


@query(f"""WITH p AS (SELECT user_id, event_id, event_id % 6 AS lap, 1 + k % 5 AS laps, CASE WHEN k % 4 = 0 THEN -1 ELSE k % 20 + 1 END AS pos, CASE WHEN k % 9 = 0 THEN 1 ELSE 20 END AS field FROM {EVENTS}),
  s AS (SELECT *, last_value(CASE WHEN field >= 2 AND pos >= 1 THEN pos END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS final FROM p)
SELECT user_id, event_id, final AS final_position, CAST(field AS INTEGER) AS total_positions, laps AS race_laps FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM s WHERE lap > laps) WHERE r = 1""")
def race_result(spark, d):
    p = events(spark, d).select(
        "user_id", "event_id", (F.col("event_id") % 6).alias("current_lap"), (1 + F.col("k") % 5).alias("total_laps"),
        F.when(F.col("k") % 4 == 0, F.lit(-1).cast("long")).otherwise(F.col("k") % 20 + 1).alias("race_position"), F.when(F.col("k") % 9 == 0, 1).otherwise(20).alias("total_positions"),
    )
    return laps.race_result(p, ["user_id"], "event_id")


def _contact(along: str, across: str) -> str:
    return f"round(x + {along} * fx + {across} * fz, 3) + 0.0::DOUBLE AS wheel_x, round(z + {along} * fz - {across} * fx, 3) + 0.0::DOUBLE AS wheel_z"


_CONTACTS = " UNION ALL ".join(f"SELECT event_id, '{w}' AS wheel, {_contact(a, b)} FROM p" for w, a, b in (("FL", "1.35", "-0.83"), ("FR", "1.35", "0.83"), ("RL", "-1.35", "-0.83"), ("RR", "-1.35", "0.83")))


@query(f"""WITH p AS (SELECT event_id, x, z, vx / sqrt(vx * vx + vz * vz) AS fx, vz / sqrt(vx * vx + vz * vz) AS fz FROM (
  SELECT event_id, CAST(k AS DOUBLE) + 0.0003 AS x, CAST(event_id % 97 AS DOUBLE) + 0.0001 AS z, CAST(k % 7 - 3 AS DOUBLE) AS vx, CAST(event_id % 5 AS DOUBLE) AS vz FROM {EVENTS}) WHERE vx <> 0 OR vz <> 0) {_CONTACTS}""")
def wheel_contacts(spark, d):
    num = lambda c: F.expr(c).cast("double")
    p = events(spark, d).select("event_id", (num("k") + 0.0003).alias("x"), (num("event_id % 97") + 0.0001).alias("z"), num("k % 7 - 3").alias("vx"), num("event_id % 5").alias("vz"))
    return survey.wheel_contacts(p, "x", "z", "vx", "vz", 2.7, 1.66).select("event_id", "wheel", "wheel_x", "wheel_z")


@query(f"SELECT event_id, round(a - 2 * pi() * ceil((a - pi()) / (2 * pi())), 9) AS wrapped FROM (SELECT event_id, CAST(v - k * 700 AS DOUBLE) / 37 AS a FROM {EVENTS})")
def wrap_angle(spark, d):
    a = (F.col("v") - F.col("k") * 700).cast("double") / 37
    return events(spark, d).select("event_id", F.round(bits.wrap_angle(a), 9).alias("wrapped"))


@query(f"""SELECT event_id, list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_position(w, w[i]) = i THEN w[i] ELSE '' END), lambda x: x IN ('login', 'view', 'refund', 'purchase')) AS chosen FROM (
  SELECT event_id, [event_type, 'view', 'nothing', event_type, CASE WHEN k % 2 = 0 THEN 'refund' ELSE 'login' END] AS w FROM {EVENTS})""")
def list_spec(spark, d):
    spec = F.concat(F.lit(" "), F.col("event_type"), F.lit(",view , nothing,"), F.col("event_type"), F.lit(","), F.when(F.col("k") % 2 == 0, "refund").otherwise("login"))
    return events(spark, d).select("event_id", units.list_spec(spec, ["login", "view", "refund", "purchase"]).alias("chosen"))


_POLICY_ROWS = ", ".join(f"('{a}', '{b}', {c}, {e}, {str(f).lower()})" for a, b, c, _, e, f in engineer.POLICIES)


@query(f"""WITH p(event_type, category, priority, cooldown_s, interrupts) AS (VALUES {_POLICY_ROWS}), n AS (SELECT row_number() OVER (ORDER BY event_type) - 1 AS n, * FROM p)
SELECT user_id, category, CAST(max(priority) AS INTEGER) AS priority, CAST(count(*) AS BIGINT) AS said, CAST(count(CASE WHEN interrupts THEN 1 END) AS BIGINT) AS interrupts, CAST(sum(cooldown_s) AS BIGINT) AS silence_s
  FROM {EVENTS} JOIN n ON n = k % 28 GROUP BY user_id, category""")
def policy_load(spark, d):
    """What every user would be told by category, each event standing for one of the 28 kinds."""
    names = F.array(*[F.lit(n) for n in sorted(row[0] for row in engineer.POLICIES)])
    said = events(spark, d).withColumn("event_type", F.get(names, (F.col("k") % 28).cast("int"))).join(F.broadcast(engineer.policies(spark)), "event_type")  # 28 rows
    return said.groupBy("user_id", "category").agg(F.max("priority").alias("priority"), F.count("*").alias("said"), F.count_if("interrupts").alias("interrupts"), F.sum("cooldown_s").alias("silence_s"))


@query()
def corner_detection(spark, d):
    """Corners of laps whose line winds with the event numbers; tests hold the scan against shapes of known corners."""
    t = _ticks(spark, d)
    bend = F.sum(F.when(F.col("i") % 60 < 12, F.lit(0.12)).otherwise(0.0) * F.when(F.col("i") % 120 < 60, 1).otherwise(-1)).over(ordered(["user_id"], "i").rowsBetween(-(1 << 30), 0))
    t = t.withColumn("heading", bend)
    step = lambda f: F.sum(5.0 * f("heading")).over(ordered(["user_id"], "i").rowsBetween(-(1 << 30), 0))
    return corners.detect(t.withColumns({"pos_x": step(F.cos), "pos_z": step(F.sin)}), ["user_id"])


def coaching_tables(spark, d):
    """Events as laps of eight ticks 100 m apart, with pedals, speeds and chassis events by event number, and three corners for every lap."""
    place = F.row_number().over(ordered(["user_id"], "event_id")) - 1
    e = events(spark, d).withColumn("i", place).withColumn("number", F.floor(F.col("i") / 8).cast("int"))
    e = e.withColumn("lap", F.col("user_id") * 100_000 + F.col("number")).withColumn("j", F.col("i") % 8)
    rows = e.groupBy(F.col("user_id").alias("session"), "lap", "number").agg((80_000 + F.sum("k")).alias("time_ms"), (F.count("*") == 8).alias("counts"))
    samples = e.select("lap", (100.0 * F.col("j")).alias("dist"), (2.0 * F.col("j") + F.col("k") / 250).alias("t"), (100 + F.col("k")).cast("double").alias("speed"), F.when(F.col("k") % 3 == 0, 50.0).otherwise(0.0).alias("brake"))
    kind = F.when(F.col("k") % 4 == 0, "lockup").when(F.col("k") % 4 == 1, "wheelspin").when(F.col("k") % 8 == 2, "bottoming").otherwise("kerb")
    wheels = F.when(F.col("k") % 2 == 0, F.array(F.lit("fl"))).otherwise(F.array(F.lit("rl"), F.lit("rr")))
    happened = e.select("lap", F.col("j").cast("int").alias("n"), kind.alias("type"), F.when(F.col("k") % 4 == 0, 0.7).otherwise(1.3).alias("severity"), (100.0 * (F.col("j") % 3)).alias("start_dist"), wheels.alias("wheels"))
    spots = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("entry_dist"), F.lit(b).alias("exit_dist")) for n, a, b in ((1, 150.0, 320.0), (2, 400.0, 480.0), (3, 650.0, 20.0))]))
    return rows.select("session", "lap", "number", "time_ms", "counts"), samples, happened, rows.select("lap", spots.alias("c")).select("lap", "c.*")


@query()
def coaching_replay(spark, d):
    """What every lap is told against the best before it; tests hold it against a walk over the laps."""
    return coaching.notes(*coaching_tables(spark, d))


def edge_ride_ticks(spark, d):
    """Events as ticks of cars that ride over a kerb and back every 27 ticks, each user with a width of its own."""
    i = F.row_number().over(ordered(["user_id"], "event_id")) - 1
    a = F.when(F.col("i") % 27 < 10, 0.1).when(F.col("i") % 27 < 20, -0.1).otherwise(0.0)
    t = events(spark, d).select("user_id", "event_id", i.alias("i")).withColumn("a", a).withColumns({"vx": 240 * F.cos("a"), "vz": 240 * F.sin("a"), "wheelbase": F.lit(2.6)})
    so_far = ordered(["user_id"], "i").rowsBetween(-(1 << 30), 0)
    t = t.withColumns({"x": F.sum(F.col("vx") / 60).over(so_far), "z": F.sum(F.col("vz") / 60).over(so_far), "half": 0.6 + (F.col("user_id") % 8) / 20})
    contact = lambda along, across: F.col("z") + along * 1.3 * F.sin("a") - across * F.col("half") * F.cos("a")
    letters = [F.when(contact(m, n) > 1.0, "C").otherwise("T") for m, n in zip(edge_rides.ALONG, edge_rides.ACROSS)]
    return t.select("user_id", F.col("i").alias("tick"), F.concat(*letters).alias("surface"), "x", "z", "vx", "vz", "wheelbase")


@query()
def edge_ride_widths(spark, d):
    """Widths of axles from rides over a kerb; tests hold the planted widths."""
    return edge_rides.rides(edge_ride_ticks(spark, d), ["user_id"], "tick")


@query()
def layout_pairs(spark, d):
    """Parts as layouts of a circuit (brand) paired one to one with its kinds by size; tests hold the pairing against a loop."""
    p = table(spark, d, "part")
    left = p.select(F.col("p_brand").alias("circuit"), F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_name").alias("name"), F.col("p_retailprice").alias("length"))
    kinds = p.groupBy(F.col("p_brand").alias("circuit"), "p_size").agg(F.min("p_partkey").alias("id"), F.min(F.concat_ws(" ", "p_type", "p_name")).alias("name"), F.avg("p_retailprice").alias("length"))
    out = pairing.paired(left, kinds.select("circuit", "id", "name", "length"))
    return out.select("circuit", "a", "b", F.round("score", 6).alias("score"))
