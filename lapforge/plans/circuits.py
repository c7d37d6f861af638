"""Queries of border ordering, road geometry and the road judge, registered beside the catalogue's.

Orders stand in for the border cells of surveyed circuits, 768 to a circuit and half of them on either side: cell i of a side lies i metres along a
ring of twelve straights of 32 cells, of which two opposite ones are longer than surveyed (a hole of up to 24 m). The right border lies 8 m
outside the left one. Headings point either way, and nothing tells the operators the order. Events are positions of laps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapforge.operators import borders, road

from .catalog import EVENTS, events, query, table

# The directions of the twelve straights, and where each begins.
_DX = (1.0, 0.8, 0.6, 0.0, -0.6, -0.8, -1.0, -0.8, -0.6, 0.0, 0.6, 0.8)
_DZ = (0.0, 0.6, 0.8, 1.0, 0.8, 0.6, 0.0, -0.6, -0.8, -1.0, -0.8, -0.6)
_X = tuple(round(32 * sum(_DX[:e]), 1) for e in range(12))
_Z = tuple(round(32 * sum(_DZ[:e]), 1) for e in range(12))
KEYS = ["circuit", "side"]
STEP = 3.713  # not a whole number, so that no sample falls on a corner


def _place(pick, key: str, at: str, side: str) -> dict[str, str]:
    """SQL text, the same for both engines, of the place of cell number ``at`` of a circuit; ``pick`` reads entry n of a list of numbers."""
    circuit, e, r = f"({key} // 768)" if pick is _pick_sql else f"({key} div 768)", f"({at} // 32)" if pick is _pick_sql else f"({at} div 32)", f"({at} % 32)"
    longer, hole = f"({circuit} % 6)", f"(3 * ({circuit} % 9))"

    def c(start, step, normal):
        far = " + ".join(f"CASE WHEN {e} > {n} THEN {hole} * {pick(step, n)} ELSE 0 * {pick(step, n)} END" for n in (longer, f"({longer} + 6)"))
        return f"({pick(start, e)} + {r} * {pick(step, e)} + {far} + {side} * {pick(normal, e)})"

    return {"x": c(_X, _DX, _DZ) + " + 0.01317", "z": c(_Z, _DZ, tuple(-d for d in _DX)) + " + 0.01739", "dx": pick(_DX, e), "dz": pick(_DZ, e)}


def _pick_spark(numbers: tuple[float, ...], n: str) -> str:
    return f"element_at(array({', '.join(f'{x}D' for x in numbers)}), cast({n} + 1 as int))"


def _pick_sql(numbers: tuple[float, ...], n: str) -> str:
    return f"list_extract(CAST([{', '.join(map(str, numbers))}] AS DOUBLE[]), CAST({n} + 1 AS INTEGER))"


def _numbers(text: str) -> str:
    return text.replace("0.01317", "0.01317D").replace("0.01739", "0.01739D")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """(circuit, side, id, nth, x, z, hx, hz, y) of every order."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    p = _place(_pick_spark, "o_orderkey", "((o_orderkey % 768) div 2)", "(8.0D * (o_orderkey % 2))")
    sign = "CASE WHEN o_custkey % 2 = 0 THEN 1.0D ELSE -1.0D END"
    return o.select(
        F.expr("o_orderkey div 768").alias("circuit"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'L' ELSE 'R' END").alias("side"), F.col("o_orderkey").alias("id"), F.expr("(o_orderkey % 768) div 2").alias("nth"),
        F.expr(_numbers(p["x"])).alias("x"), F.expr(_numbers(p["z"])).alias("z"), F.expr(f"{sign} * {p['dx']}").alias("hx"), F.expr(f"{sign} * {p['dz']}").alias("hz"),
        F.expr("CASE WHEN o_custkey % 3 > 0 THEN sqrt(o_custkey % 50 + 0.37D) END").alias("y"),
    )


_P = _place(_pick_sql, "o_orderkey", "((o_orderkey % 768) // 2)", "(8.0 * (o_orderkey % 2))")
_SIGN = "CASE WHEN o_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
_CELLS = f"""(SELECT o_orderkey // 768 AS circuit, CASE WHEN o_orderkey % 2 = 0 THEN 'L' ELSE 'R' END AS side, o_orderkey AS id, (o_orderkey % 768) // 2 AS nth,
  CAST({_P['x']} AS DOUBLE) AS x, CAST({_P['z']} AS DOUBLE) AS z, {_SIGN} * {_P['dx']} AS hx, {_SIGN} * {_P['dz']} AS hz, CASE WHEN o_custkey % 3 > 0 THEN sqrt(o_custkey % 50 + 0.37::DOUBLE) END AS y FROM orders)"""


@query(f"""WITH RECURSIVE c AS (SELECT * FROM {_CELLS}),
  f AS (SELECT a.circuit, a.side, a.id AS a, b.id AS b, sqrt((b.x - a.x) * (b.x - a.x) + (b.z - a.z) * (b.z - a.z)) AS d,
    (b.x - a.x) * a.hx + (b.z - a.z) * a.hz AS fa, -((b.x - a.x) * b.hx + (b.z - a.z) * b.hz) AS fb, abs(a.hx * b.hx + a.hz * b.hz) AS tangent
    FROM c a JOIN c b ON a.circuit = b.circuit AND a.side = b.side AND a.id < b.id AND abs(a.x - b.x) <= 5 AND abs(a.z - b.z) <= 5),
  k AS (SELECT *, CASE WHEN fa > 0 THEN 1 ELSE -1 END AS s, CASE WHEN fb > 0 THEN 1 ELSE -1 END AS t, d / least(abs(fa / d), abs(fb / d)) AS score
    FROM f WHERE d > 0 AND d <= 5 AND least(abs(fa / d), abs(fb / d)) >= 0.35::DOUBLE AND tangent >= 0.5::DOUBLE),
  m AS (SELECT *, row_number() OVER (PARTITION BY circuit, side, i, p ORDER BY score, a, b, s, t) AS r FROM
    (SELECT *, a AS i, s AS p FROM k UNION ALL SELECT *, b AS i, t AS p FROM k)),
  n AS (SELECT circuit, side, a, s, b, t FROM m WHERE r = 1 GROUP BY circuit, side, a, s, b, t HAVING count(*) = 2),
  l AS (SELECT circuit, side, a, s, b, t FROM n UNION ALL SELECT circuit, side, b, t, a, s FROM n),
  e AS (SELECT c.circuit, c.side, c.id, q.p FROM c, (VALUES (1), (-1)) q(p) WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.circuit = c.circuit AND l.side = c.side AND l.a = c.id AND l.s = q.p)),
  w AS (SELECT circuit, side, id AS first, p AS first_port, id AS cur, -p AS port, 0 AS place FROM e
    UNION ALL SELECT w.circuit, w.side, w.first, w.first_port, l.b, -l.t, w.place + 1 FROM w JOIN l ON l.circuit = w.circuit AND l.side = w.side AND l.a = w.cur AND l.s = w.port),
  o AS (SELECT w.*, c.x, c.z, count(*) OVER (PARTITION BY w.circuit, w.side, first, first_port) AS size, row_number() OVER (PARTITION BY w.circuit, w.side, first, first_port ORDER BY c.x, c.z, c.id) AS nth FROM w JOIN c ON c.id = w.cur),
  h AS (SELECT circuit, side, first, first_port, cur AS chain FROM o WHERE nth = 1 AND port = 1),
  u AS (SELECT circuit, side, arg_min(id, {{'x': x, 'z': z, 'id': id}}) AS seed FROM c WHERE id NOT IN (SELECT cur FROM w) GROUP BY circuit, side),
  g AS (SELECT circuit, side, seed, seed AS cur, 1 AS port, 0 AS place FROM u
    UNION ALL SELECT g.circuit, g.side, g.seed, l.b, -l.t, g.place + 1 FROM g JOIN l ON l.circuit = g.circuit AND l.side = g.side AND l.a = g.cur AND l.s = g.port AND l.b <> g.seed)
SELECT o.circuit, o.side, o.cur AS id, h.chain, CAST(o.place AS BIGINT) AS place, CAST(o.size AS BIGINT) AS size FROM o JOIN h ON h.circuit = o.circuit AND h.side = o.side AND h.first = o.first AND h.first_port = o.first_port WHERE o.size >= 5
UNION ALL SELECT circuit, side, cur, seed, CAST(place AS BIGINT), CAST(count(*) OVER (PARTITION BY circuit, side) AS BIGINT) FROM g""")
def border_chains(spark, d):
    return borders.chains(cells(spark, d), KEYS).select(*KEYS, "id", "chain", "place", "size")


@query()
def compile_ring(spark, d):
    """Coverage of every border and resolved road of every circuit, from unordered cells; tests hold it against a walk in plain Python."""
    spans, covered = borders.assembled(borders.order_borders(cells(spark, d).drop("nth"), KEYS), KEYS)
    share = road.road_share(road.paired(spans, ["circuit"]), ["circuit"])
    return covered.join(share, "circuit", "left")


@query()
def ring_polylines(spark, d):
    """The thinned border polylines of every circuit, from unordered cells."""
    spans = borders.steps(borders.order_borders(cells(spark, d).drop("nth"), KEYS), KEYS)
    return road.polylines(spans, KEYS)


# --- borders whose order is known, so that SQL can follow ---------------------------


def _known_spans(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    """Spans of every border, or of the circuits on which there are positions: the road of others is near none."""
    w = Window.partitionBy(*KEYS).orderBy("nth")
    c = cells(spark, d) if of is None else cells(spark, d).join(of.select("circuit").distinct(), "circuit", "left_semi")
    p = c.repartition("circuit").withColumn("p", F.struct("id", "x", "z", "y"))  # one shuffle for all windows of a circuit
    q = F.coalesce(F.lead("p").over(w), F.when(F.col("nth") == 383, F.first("p").over(w)))
    dx, dz = F.col("q.x") - F.col("p.x"), F.col("q.z") - F.col("p.z")
    s = p.withColumn("q", q).where("q is not null").withColumn("d", F.sqrt(dx * dx + dz * dz))
    return s.select(*KEYS, F.lit(0).cast("long").alias("line"), F.col("nth").alias("place"), "p", "q", "d", (F.col("d") > borders.SURVEYED_M).alias("gap"))


_SPANS = f"""s0 AS (SELECT circuit, side, nth AS place, x AS ax, z AS az, y AS ay, lead(x) OVER w AS nx, lead(z) OVER w AS nz, lead(y) OVER w AS ny, lead(id) OVER w AS nid,
    first_value(x) OVER w AS fx, first_value(z) OVER w AS fz, first_value(y) OVER w AS fy FROM {_CELLS} WINDOW w AS (PARTITION BY circuit, side ORDER BY nth)),
  s1 AS (SELECT circuit, side, place, ax, az, ay, CASE WHEN nid IS NULL THEN fx ELSE nx END AS bx, CASE WHEN nid IS NULL THEN fz ELSE nz END AS bz, CASE WHEN nid IS NULL THEN fy ELSE ny END AS by_ FROM s0 WHERE nid IS NOT NULL OR place = 383),
  s2 AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (bz - az) * (bz - az)) AS d FROM s1),
  s3 AS (SELECT *, d > 6 AS gap, sum(CASE WHEN d > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY circuit, side ORDER BY place) AS run FROM s2),
  s4 AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY circuit, side, run ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s3 WHERE NOT gap)"""
_SAMPLES = f"""{_SPANS}, k0 AS (SELECT *, unnest(range(CAST(ceil(start / {STEP}::DOUBLE) AS BIGINT), CAST(ceil((start + d) / {STEP}::DOUBLE) AS BIGINT))) AS k FROM s4 WHERE d >= 0.000000001::DOUBLE),
  k1 AS (SELECT *, (k * {STEP}::DOUBLE - start) / d AS f FROM k0),
  k2 AS (SELECT circuit, side, run, k, ax + (bx - ax) * f AS x, az + (bz - az) * f AS z, coalesce(ay + (by_ - ay) * f, ay, by_) AS y, (bx - ax) / d AS tx, (bz - az) / d AS tz FROM k1)"""


@query(f"""WITH {_SAMPLES} SELECT circuit, side, CAST(run AS INTEGER) AS run, k, round(x, 3) AS x, round(z, 3) AS z, round(y, 3) AS y, round(tx, 6) AS tx, round(tz, 6) AS tz FROM k2""")
def border_samples(spark, d):
    s = road.samples(_known_spans(spark, d), KEYS, STEP)
    return s.select(*KEYS, "run", "k", *[F.round(c, 3).alias(c) for c in "xzy"], F.round("tx", 6).alias("tx"), F.round("tz", 6).alias("tz"))


_PAIRS = f"""{_SAMPLES}, n0 AS (SELECT l.circuit, l.run, l.k, l.x, l.z, l.y, l.tx, l.tz, r.place, r.ax, r.az, r.ay, r.bx, r.bz, r.by_,
    greatest(0.0, least(1.0, ((l.x - r.ax) * (r.bx - r.ax) + (l.z - r.az) * (r.bz - r.az)) / (r.d * r.d))) AS t FROM k2 l JOIN s4 r ON l.side = 'L' AND r.side = 'R' AND l.circuit = r.circuit
    AND abs(floor((r.ax + r.bx) / 2 / 40) - floor(l.x / 40)) <= 1 AND abs(floor((r.az + r.bz) / 2 / 40) - floor(l.z / 40)) <= 1),
  n1 AS (SELECT *, ax + (bx - ax) * t AS rx, az + (bz - az) * t AS rz, coalesce(ay + (by_ - ay) * t, ay, by_) AS ry FROM n0),
  n2 AS (SELECT *, sqrt((rx - x) * (rx - x) + (rz - z) * (rz - z)) AS width FROM n1),
  n3 AS (SELECT * FROM n2 QUALIFY row_number() OVER (PARTITION BY circuit, run, k ORDER BY width, place) = 1),
  n4 AS (SELECT k2.circuit, k2.run, k2.k, k2.x, k2.z, k2.y, width, rx, rz, ry, coalesce(width BETWEEN 3 AND 40 AND abs((rx - k2.x) * k2.tz - (rz - k2.z) * k2.tx) / width >= 0.7::DOUBLE, false) AS ok
    FROM k2 LEFT JOIN n3 ON n3.circuit = k2.circuit AND n3.run = k2.run AND n3.k = k2.k WHERE k2.side = 'L'),
  n5 AS (SELECT *, 1 + sum(CASE WHEN NOT ok AND k > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY circuit, run ORDER BY k) AS part, lag(ok) OVER v AS was, lag(x) OVER v AS px, lag(z) OVER v AS pz, lag(rx) OVER v AS prx, lag(rz) OVER v AS prz FROM n4
    WINDOW v AS (PARTITION BY circuit, run ORDER BY k)),
  n6 AS (SELECT circuit, run, part, k, round((x + rx) / 2, 2) AS x, round((z + rz) / 2, 2) AS z, round(coalesce((y + ry) / 2, y, ry), 2) AS y, round(width, 1) AS w FROM n5 WHERE ok QUALIFY count(*) OVER (PARTITION BY circuit, run, part) >= 2)"""


@query(f"WITH {_PAIRS} SELECT circuit, CAST(run AS INTEGER) AS run, CAST(part AS INTEGER) AS part, k, x, z, y, w FROM n6")
def road_centreline(spark, d):
    pairs = road.paired(_known_spans(spark, d), ["circuit"], STEP)
    return road.centreline(pairs, ["circuit"]).drop("line")


_QUADS = f"""{_PAIRS}, q AS (SELECT circuit, run, k, round(px, 1) + 0.0::DOUBLE AS x1, round(pz, 1) + 0.0::DOUBLE AS z1, round(x, 1) + 0.0::DOUBLE AS x2, round(z, 1) + 0.0::DOUBLE AS z2, round(rx, 1) + 0.0::DOUBLE AS x3, round(rz, 1) + 0.0::DOUBLE AS z3, round(prx, 1) + 0.0::DOUBLE AS x4, round(prz, 1) + 0.0::DOUBLE AS z4 FROM n5
    WHERE ok AND was AND sqrt((x - px) * (x - px) + (z - pz) * (z - pz)) <= 2 * {STEP}::DOUBLE)"""


@query(f"WITH {_QUADS} SELECT circuit, CAST(run AS INTEGER) AS run, k, x1, z1, x2, z2, x3, z3, x4, z4 FROM q")
def road_quads(spark, d):
    return road.quads(road.paired(_known_spans(spark, d), ["circuit"], STEP), ["circuit"], STEP).drop("line")


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    """(circuit, user_id, event_id, x, z): events as positions beside the left border, 10 m inside to 39.5 m outside."""
    p = _place(_pick_spark, "(768 * (user_id % 19))", "(event_id % 384)", "(0.5D * k - 10.0D)")
    return events(spark, d).select(F.expr("user_id % 19").alias("circuit"), "user_id", "event_id", F.expr(_numbers(p["x"])).alias("x"), F.expr(_numbers(p["z"])).alias("z"))


_T = _place(_pick_sql, "(768 * (user_id % 19))", "(event_id % 384)", "(0.5::DOUBLE * k - 10.0)")


def _off(a: tuple[str, str], b: tuple[str, str]) -> str:
    """SQL of the distance of (x, z) to a segment."""
    (ax, az), (bx, bz) = a, b
    long2 = f"(({bx} - {ax}) * ({bx} - {ax}) + ({bz} - {az}) * ({bz} - {az}))"
    t = f"(CASE WHEN {long2} > 0 THEN greatest(0.0, least(1.0, ((x - {ax}) * ({bx} - {ax}) + (z - {az}) * ({bz} - {az})) / {long2})) ELSE 0 END)"
    return f"sqrt(pow(x - ({ax} + {t} * ({bx} - {ax})), 2) + pow(z - ({az} + {t} * ({bz} - {az})), 2))"


_CORNERS = [(f"x{i}", f"z{i}") for i in (1, 2, 3, 4)]
_CROSS = [f"(({b[0]} - {a[0]}) * (z - {a[1]}) - ({b[1]} - {a[1]}) * (x - {a[0]}))" for a, b in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1])]
_NEAR = f"""{_QUADS}, t AS (SELECT user_id % 19 AS circuit, user_id, event_id, CAST({_T['x']} AS DOUBLE) AS x, CAST({_T['z']} AS DOUBLE) AS z FROM {EVENTS}),
  d0 AS (SELECT t.circuit, user_id, event_id, x, z, run, k, CASE WHEN ({' AND '.join(f'{c} >= 0' for c in _CROSS)}) OR ({' AND '.join(f'{c} <= 0' for c in _CROSS)}) THEN 0.0
    ELSE least({', '.join(_off(a, b) for a, b in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1]))}) END AS distance FROM t JOIN q ON q.circuit = t.circuit),
  d1 AS (SELECT * FROM d0 WHERE distance <= 30 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY distance, run, k) = 1)"""


@query(f"WITH {_NEAR} SELECT circuit, event_id, round(distance, 4) AS distance FROM d1")
def nearest_quad(spark, d):
    t = _ticks(spark, d)
    pairs = road.paired(_known_spans(spark, d, t), ["circuit"], STEP)
    near = road.nearest_quad(t, road.quads(pairs, ["circuit"], STEP), ["circuit"], ["event_id"])
    return near.select("circuit", "event_id", F.round("distance", 4).alias("distance"))


_JUDGE = f"""{_NEAR}, b AS (SELECT circuit, round(ax, 1) AS x1, round(az, 1) AS z1, round(bx, 1) AS x2, round(bz, 1) AS z2 FROM s3 WHERE gap
    UNION ALL SELECT circuit, arg_min(x, k), arg_min(z, k), arg_min(x, k), arg_min(z, k) FROM n6 GROUP BY circuit, run, part UNION ALL SELECT circuit, arg_max(x, k), arg_max(z, k), arg_max(x, k), arg_max(z, k) FROM n6 GROUP BY circuit, run, part),
  g AS (SELECT d1.event_id FROM d1 JOIN b ON b.circuit = d1.circuit AND distance > 1 WHERE {_off(("x1", "z1"), ("x2", "z2"))} <= distance + 1 GROUP BY d1.event_id),
  j AS (SELECT t.circuit, t.user_id, t.event_id, CASE WHEN distance <= 1 THEN 'on' WHEN distance IS NULL OR g.event_id IS NOT NULL THEN 'unknown' ELSE 'off' END AS verdict
    FROM t LEFT JOIN d1 ON d1.event_id = t.event_id LEFT JOIN g ON g.event_id = t.event_id)"""


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    t = _ticks(spark, d)
    spans = _known_spans(spark, d, t)
    pairs = road.paired(spans, ["circuit"], STEP)
    return road.judged(t, road.quads(pairs, ["circuit"], STEP), road.unsurveyed(spans, pairs, ["circuit"]), ["circuit"], ["event_id"])


@query(f"WITH {_JUDGE} SELECT circuit, event_id, verdict FROM j")
def road_judge(spark, d):
    return _verdicts(spark, d).select("circuit", "event_id", "verdict")


@query(f"""WITH {_JUDGE}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, verdict ORDER BY event_id) AS island FROM j),
  r AS (SELECT user_id FROM i WHERE verdict = 'off' GROUP BY user_id, island HAVING count(*) >= 6), c AS (SELECT user_id, count(*) AS n FROM r GROUP BY user_id)
SELECT j.user_id, CAST(CASE WHEN 2 * count(CASE WHEN verdict <> 'unknown' THEN 1 END) < count(*) THEN -1 ELSE coalesce(any_value(n), 0) END AS BIGINT) AS excursions FROM j LEFT JOIN c ON c.user_id = j.user_id GROUP BY j.user_id""")
def road_excursions(spark, d):
    return road.excursions(_verdicts(spark, d), ["user_id"], "event_id")


# --- thinning of polylines ----------------------------------------------------------

_TRACE = f"(SELECT user_id, event_id, CAST(event_id % 997 AS DOUBLE) AS x, CAST(k AS DOUBLE) AS z FROM {EVENTS})"


@query(f"""WITH RECURSIVE p AS (SELECT * FROM {_TRACE}),
  s AS (SELECT user_id, min(event_id) AS lo, max(event_id) AS hi FROM p GROUP BY user_id
    UNION ALL SELECT user_id, unnest([lo, mid]), unnest([mid, hi]) FROM (
      SELECT s.user_id, s.lo, s.hi, arg_min(p.event_id, {{'d': -o.d, 'e': p.event_id}}) AS mid, max(o.d) AS d FROM s JOIN p a ON a.user_id = s.user_id AND a.event_id = s.lo JOIN p b ON b.user_id = s.user_id AND b.event_id = s.hi
        JOIN p ON p.user_id = s.user_id AND p.event_id > s.lo AND p.event_id < s.hi, LATERAL (SELECT CASE WHEN (b.x - a.x) * (b.x - a.x) + (b.z - a.z) * (b.z - a.z) = 0
          THEN sqrt((p.x - a.x) * (p.x - a.x) + (p.z - a.z) * (p.z - a.z)) ELSE abs((p.x - a.x) * (b.z - a.z) - (p.z - a.z) * (b.x - a.x)) / sqrt((b.x - a.x) * (b.x - a.x) + (b.z - a.z) * (b.z - a.z)) END AS d) o
        GROUP BY s.user_id, s.lo, s.hi) WHERE d > 40)
SELECT user_id, lo AS event_id FROM s UNION SELECT user_id, hi FROM s""")
def polyline_simplify(spark, d):
    trace = events(spark, d).select("user_id", "event_id", (F.col("event_id") % 997).cast("double").alias("x"), F.col("k").cast("double").alias("z"))
    return road.simplified(trace, ["user_id"], "event_id", 40.0).select("user_id", "event_id")
