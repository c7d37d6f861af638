"""The road between two ordered borders, and whether positions keep to it.

Input is what ``borders.assembled`` gives: spans along the lines of the borders of ``keys`` and a ``side`` (L or R).
Polylines stop at gaps of the survey and are thinned to a tolerance; samples at equal arc length along the left border are paired
with the nearest point of the right border's curve, which gives centreline, width and road quads; positions are judged
against the quads, where ground that was never surveyed judges nobody. Spatial joins meet by grid cell.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lapforge.sources.scratch import spread, staged

from . import curves, windows
from .paths import _on, _right
from .spatial import cell, segment_distance2

# Tolerance of stored polylines (m); step of samples (m); least and most road width (m); least product across.
TOLERANCE_M, STEP_M, WIDTH_MIN_M, WIDTH_MAX_M, ACROSS = 0.5, 4.0, 3.0, 40.0, 0.7
# A centre so far beyond an edge is still on (m); off only so near to road (m); rows of an excursion; least resolved road of a judge (%).
EDGE_M, NEAR_M, EXCURSION_ROWS, ROAD_PCT = 1.0, 30.0, 6, 50.0
CELL_M = 40.0
ROUNDS = 4  # of splits between two shuffles
TILE_BITS = 3  # a tile is 8 cells of the widest road wide


def _between(a: Column, b: Column, f: Column) -> Column:
    """Value at share ``f`` from a to b; where one is null, the other."""
    return F.coalesce(a + (b - a) * f, a, b)


def runs(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The surveyed spans with their run along the line (from 0; a gap begins a new one), and the metres of the run ahead of each."""
    w = Window.partitionBy(*keys, "line").orderBy("place")
    out = spans.withColumn("run", F.sum(F.col("gap").cast("int")).over(w).cast("int")).where("not gap")
    ahead = Window.partitionBy(*keys, "line", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("start", F.coalesce(F.sum("d").over(ahead), F.lit(0.0)))


def polylines(spans: DataFrame, keys: list[str], tolerance: float | None = TOLERANCE_M) -> DataFrame:
    """(keys, line, run, nth, x, z, y): vertices of each surveyed run, to centimetres, thinned to ``tolerance`` (None: all)."""
    by = [*keys, "line", "run"]
    first = F.row_number().over(Window.partitionBy(*by).orderBy("place")) == 1
    p, q = F.struct(F.col("place").alias("nth"), "p"), F.struct((F.col("place") + 1).alias("nth"), F.col("q").alias("p"))
    points = runs(spans, keys).withColumn("first", first).withColumn("v", F.explode(F.when(F.col("first"), F.array(p, q)).otherwise(F.array(q)))).select(*by, "v.*")
    cm = lambda c: F.round(f"p.{c}", 2).alias(c)
    points = points.select(*by, "nth", cm("x"), cm("z"), cm("y"))
    return points if tolerance is None else simplified(points, by, "nth", tolerance)


def simplified(points: DataFrame, keys: list[str], order: str, tolerance: float) -> DataFrame:
    """The vertices (x, z) that Douglas-Peucker keeps of each polyline of ``keys`` in ``order``, which is unique in a polyline.

    Every round splits all open segments of all polylines at their farthest point (the first of equals), so rounds follow the depth of the splits.
    A round is a window over the segments; as they lie within their polyline, ``ROUNDS`` of them share one shuffle of the points that are still open.
    """
    own = F.struct(F.col(order).alias("o"), F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"))
    whole = Window.partitionBy(*keys)
    rows = points.where(F.col(order).isNotNull()).withColumn("_p", own).withColumns({"_a": F.min("_p").over(whole), "_b": F.max("_p").over(whole)})
    rows = rows.withColumn("_kept", (F.col("_p.o") == F.col("_a.o")) | (F.col("_p.o") == F.col("_b.o")))
    kept = None
    while True:
        for _ in range(ROUNDS):
            rows = _split(rows, keys, tolerance)
        rows = staged(rows, "segments")
        done = rows.where("_kept").select(*points.columns)
        kept = done if kept is None else kept.unionByName(done)
        rows = rows.where("not _kept")
        left = rows.count()
        if left == 0:
            return kept
        rows = spread(rows, *keys, rows=left)


def _split(rows: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """One round: open points (_p between the ends _a and _b of their segment) go if their segment is within ``tolerance``, else it is split at the farthest, which is kept."""
    at = lambda c: F.col(f"_{c[0]}.{c[1]}")
    dx, dz, px, pz = at("bx") - at("ax"), at("bz") - at("az"), at("px") - at("ax"), at("pz") - at("az")
    length = F.sqrt(dx * dx + dz * dz)
    off = F.when(length < 1e-9, F.sqrt(px * px + pz * pz)).otherwise(F.abs(px * dz - pz * dx) / length)
    rows = rows.withColumn("_lo", F.when(~F.col("_kept"), F.col("_a.o")))
    worst = F.max(F.when(~F.col("_kept"), F.struct(off.alias("off"), (-F.col("_p.o")).alias("r"), F.col("_p").alias("p"))))
    rows = rows.withColumn("_w", worst.over(Window.partitionBy(*keys, "_lo"))).where(F.col("_kept") | (F.col("_w.off") > tolerance))
    before, w = F.col("_p.o") < F.col("_w.p.o"), F.col("_w.p")
    return rows.withColumns({
        "_kept": F.col("_kept") | (F.col("_p.o") == F.col("_w.p.o")), "_a": F.when(before, F.col("_a")).otherwise(w), "_b": F.when(before, w).otherwise(F.col("_b")),
    }).drop("_lo", "_w")


def gap_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x1, z1, x2, z2) of the flagged gaps, to decimetres."""
    return spans.where("gap").select(*keys, *[F.round(f"{e}.{c}", 1).alias(f"{c}{i}") for i, e in ((1, "p"), (2, "q")) for c in "xz"])


def samples(spans: DataFrame, keys: list[str], step: float = STEP_M) -> DataFrame:
    """(keys, line, run, k, x, z, y, tx, tz) every ``step`` metres of arc from the start of each surveyed run, with the tangent."""
    r = runs(spans, keys).where("d >= 1e-9")
    low, high = F.ceil(F.col("start") / step).cast("long"), F.ceil((F.col("start") + F.col("d")) / step).cast("long") - 1
    r = r.withColumn("low", low).withColumn("high", high).where("high >= low").withColumn("k", F.explode(F.sequence("low", "high")))
    f = (F.col("k") * step - F.col("start")) / F.col("d")
    mid = lambda c: _between(F.col(f"p.{c}"), F.col(f"q.{c}"), f).alias(c)
    tangent = lambda c: ((F.col(f"q.{c}") - F.col(f"p.{c}")) / F.col("d")).alias(f"t{c}")
    return r.select(*keys, "line", "run", "k", mid("x"), mid("z"), mid("y"), tangent("x"), tangent("z"))


def paired(spans: DataFrame, keys: list[str], step: float = STEP_M) -> DataFrame:
    """Left samples with the nearest point of the right curve (rx, rz, ry, width), null where the road is not plainly across."""
    left = samples(spans.where("side = 'L'"), keys, step)
    right = spans.where("side = 'R' and not gap")
    middle = lambda c: cell((F.col(f"p.{c}") + F.col(f"q.{c}")) / 2, WIDTH_MAX_M)
    ends = [F.col(f"{e}.{c}").cast("double").alias(f"{e}{c}") for e in "pq" for c in "xzy"]
    right = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("line").alias("of"), "place", *ends, middle("x").alias("cx"), middle("z").alias("cz")).where("cx is not null and cz is not null")
    # a span goes to the tiles of the cells around it (one, but on the rim of a tile), so a point finds all it asks for in its own
    for c in ("cx", "cz"):
        right = right.withColumn(f"_{c}", F.explode(F.array_distinct(F.array(*[F.shiftright(F.col(c) + i, TILE_BITS) for i in (-1, 1)]))))
    at = left.withColumns({"cx": cell("x", WIDTH_MAX_M), "cz": cell("z", WIDTH_MAX_M)})
    at = at.withColumns({f"_{c}": F.shiftright(c, TILE_BITS) for c in ("cx", "cz")})
    carried, found = left.columns, ["width", "t", "rx", "rz", "py", "qy"]

    def nearest(points: pa.Table, spans: pa.Table) -> pa.Table:
        spans = spans.take(pc.sort_indices(spans, [("of", "ascending"), ("place", "ascending")]))
        part = lambda table, *names: tuple(table.column(c).to_numpy() for c in names)
        out = points.select(carried)
        known = pc.and_(points.column("cx").is_valid(), points.column("cz").is_valid())
        if points.num_rows == 0 or spans.num_rows == 0 or not pc.all(known).as_py():  # cells are null for a whole tile
            return pa.table([*out.columns, *[pa.nulls(points.num_rows, pa.float64())] * len(found)], names=[*carried, *found])
        j, *values = curves.nearest_spans(*part(points, "x", "z"), part(points, "cx", "cz"), part(spans, "px", "pz", "qx", "qz"), part(spans, "cx", "cz"))
        at = pa.array(j, mask=j < 0)
        return pa.table([*out.columns, *[pa.array(v, mask=j < 0) for v in values], spans.column("py").take(at), spans.column("qy").take(at)], names=[*carried, *found])

    schema = StructType([*left.schema.fields, *[StructField(c, DoubleType()) for c in found]])
    tile = ["_cx", "_cz"]
    out = at.groupBy(*keys, *tile).cogroup(right.groupBy(*[f"r_{k}" for k in keys], *tile)).applyInArrow(nearest, schema)
    out = out.withColumn("ry", _between(F.col("py"), F.col("qy"), F.col("t")))
    across = F.abs((F.col("rx") - F.col("x")) * F.col("tz") - (F.col("rz") - F.col("z")) * F.col("tx")) / F.col("width")
    good = F.coalesce(F.col("width").between(WIDTH_MIN_M, WIDTH_MAX_M) & (across >= ACROSS), F.lit(False))
    return staged(out.select(*left.columns, *[F.when(good, F.col(c)).alias(c) for c in ("width", "rx", "rz", "ry")]), "paired")


def centreline(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, run, part, k, x, z, y, w): the middle of the road; a part ends where a sample found no road across."""
    by = [*keys, "line", "run"]
    p = windows.segments(pairs, by, "k", F.col("width").isNull(), "part").where("width is not null")
    y = F.coalesce((F.col("y") + F.col("ry")) / 2, "y", "ry")
    mid = [F.round((F.col("x") + F.col("rx")) / 2, 2).alias("x"), F.round((F.col("z") + F.col("rz")) / 2, 2).alias("z"), F.round(y, 2).alias("y"), F.round("width", 1).alias("w")]
    n = F.count("*").over(Window.partitionBy(*by, "part"))
    return p.withColumn("n", n).where("n >= 2").select(*by, F.col("part").cast("int").alias("part"), "k", *mid)


def quads(pairs: DataFrame, keys: list[str], step: float = STEP_M) -> DataFrame:
    """(keys, line, run, k, x1..z4): road between consecutive pairs at most two steps apart, to decimetres."""
    by = [*keys, "line", "run"]
    now = F.struct("x", "z", "rx", "rz", "width")
    q = pairs.withColumn("b", F.lag(now).over(Window.partitionBy(*by).orderBy("k"))).where("width is not null and b.width is not null")
    dx, dz = F.col("x") - F.col("b.x"), F.col("z") - F.col("b.z")
    corner = [("b.x", "x1"), ("b.z", "z1"), ("x", "x2"), ("z", "z2"), ("rx", "x3"), ("rz", "z3"), ("b.rx", "x4"), ("b.rz", "z4")]
    return q.where(F.sqrt(dx * dx + dz * dz) <= 2 * step).select(*by, "k", *[F.round(c, 1).alias(a) for c, a in corner])


def road_share(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, road_pct): share of left samples with the right border across from them."""
    return pairs.groupBy(*keys).agg(F.round(100.0 * F.count("width") / F.count("*"), 1).alias("road_pct"))


def _spread(df: DataFrame, keys: list[str], xs: list[str], zs: list[str], reach: float) -> DataFrame:
    """Rows once for each cell within ``reach`` of their bounding box (r_cx, r_cz), keys with the prefix r_."""
    least = lambda f, cs, m: cell(f(*cs) + m if len(cs) > 1 else F.col(cs[0]) + m, CELL_M)
    span = lambda cs: F.sequence(least(F.least, cs, -reach), least(F.greatest, cs, reach))
    out = df.withColumnsRenamed({k: f"r_{k}" for k in keys}).withColumn("r_cx", F.explode(span(xs)))
    return out.withColumn("r_cz", F.explode(span(zs)))


def nearest_quad(points: DataFrame, road: DataFrame, keys: list[str], ids: list[str], reach: float = NEAR_M) -> DataFrame:
    """(keys, ids, distance, quad) of the nearest road quad within ``reach`` of each point (x, z); 0 inside; ties to the smaller (line, run, k)."""
    name = F.struct("line", "run", "k").alias("quad")
    corners = [f"{c}{i}" for i in (1, 2, 3, 4) for c in "xz"]
    q = road.select(*keys, name, *corners)
    for i, j in ((1, 2), (2, 3), (3, 4), (4, 1)):  # edges once a quad, so that a pair costs a few products
        ex, ez = F.col(f"x{j}") - F.col(f"x{i}"), F.col(f"z{j}") - F.col(f"z{i}")
        q = q.withColumns({f"ex{i}": ex, f"ez{i}": ez, f"e{i}": ex * ex + ez * ez})
    q = _spread(q, keys, corners[0::2], corners[1::2], reach)
    p = points.select(*keys, *ids, "x", "z", cell("x", CELL_M).alias("cx"), cell("z", CELL_M).alias("cz"))
    near = p.join(q, _on(keys, {"cx": "r_cx", "cz": "r_cz"}))
    crosses, squares = [], []
    for i in (1, 2, 3, 4):
        px, pz, ex, ez, long2 = F.col("x") - F.col(f"x{i}"), F.col("z") - F.col(f"z{i}"), F.col(f"ex{i}"), F.col(f"ez{i}"), F.col(f"e{i}")
        cross, along = ex * pz - ez * px, ex * px + ez * pz
        crosses.append(cross)
        squares.append(F.when(along <= 0, px * px + pz * pz).when(along < long2, cross * cross / long2))  # beyond its end, the next edge is as near
    inside = (F.least(*crosses) >= 0) | (F.greatest(*crosses) <= 0)
    d = F.when(inside, 0.0).otherwise(F.sqrt(F.least(*squares)))
    best = near.groupBy(*keys, *ids).agg(F.min(F.struct(d.alias("distance"), "quad")).alias("m"))
    return best.where(F.col("m.distance") <= reach).select(*keys, *ids, "m.distance", "m.quad")


def unsurveyed(spans: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x1, z1, x2, z2): ground that the survey never saw: flagged gaps of either border and the open ends of centreline parts."""
    by = [*keys, "line", "run", "part"]
    at = lambda f: f(F.struct("k", "x", "z"))
    ends = centreline(pairs, keys).groupBy(*by).agg(at(F.min).alias("a"), at(F.max).alias("b"))
    ends = ends.select(*keys, F.explode(F.array("a", "b")).alias("e")).select(*keys, F.col("e.x").alias("x1"), F.col("e.z").alias("z1"), F.col("e.x").alias("x2"), F.col("e.z").alias("z2"))
    return gap_spans(spans, keys).unionByName(ends)


def judged(points: DataFrame, road: DataFrame, blind: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """points with verdict: on (within 1 m of a quad), off (within 30 m of one, no unsurveyed ground as near, with 1 m to spare), else unknown."""
    found = nearest_quad(points, road, keys, ids)
    near = _right(found, [*keys, *ids], distance="distance")
    rows = points.join(near, _on([*keys, *ids], {}), "left").select(*points.columns, "distance")
    rows = staged(rows, "near-road")
    beyond = rows.where(F.col("distance") > EDGE_M).select(*keys, *ids, "x", "z", "distance", cell("x", CELL_M).alias("cx"), cell("z", CELL_M).alias("cz"))
    mask = _spread(blind, keys, ["x1", "x2"], ["z1", "z2"], NEAR_M + EDGE_M)
    hit = beyond.join(mask, _on(keys, {"cx": "r_cx", "cz": "r_cz"}))
    d = F.sqrt(segment_distance2(F.col("x"), F.col("z"), F.col("x1"), F.col("z1"), F.col("x2"), F.col("z2")))
    masked = _right(hit.where(d <= F.col("distance") + EDGE_M).select(*keys, *ids).distinct().withColumn("masked", F.lit(True)), [*keys, *ids], masked="masked")
    verdict = F.when(F.col("distance") <= EDGE_M, "on").when(F.col("distance").isNull() | F.col("masked"), "unknown").otherwise("off")
    return rows.join(masked, _on([*keys, *ids], {}), "left").select(*points.columns, verdict.alias("verdict"))


def excursions(verdicts: DataFrame, lap: list[str], order: str, least: int = EXCURSION_ROWS) -> DataFrame:
    """(lap, excursions): runs of ``least`` or more consecutive rows off; -1 where fewer than half the rows have a verdict."""
    n = windows.islands(verdicts, lap, order, F.col("verdict") == "off", least).groupBy(*lap).agg(F.count("*").alias("n"))
    known = verdicts.groupBy(*lap).agg(F.count("*").alias("rows"), F.count_if(F.col("verdict") != "unknown").alias("known"))
    n = _right(n, lap, n="n")
    count = F.when(2 * F.col("known") < F.col("rows"), -1).otherwise(F.coalesce("n", F.lit(0)))
    return known.join(n, _on(lap, {}), "left").select(*lap, count.cast("long").alias("excursions"))
