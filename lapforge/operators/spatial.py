"""Plane geometry by grid cells: coverage, nearest points, pairs across, segments, quads.

Every join has the cell of a grid as its key, one side spread to the neighbouring cells,
so a point meets only what lies within reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.sources.scratch import staged


def cell(c: Column | str, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size).cast("long")


def around(df: DataFrame, x: str, z: str, size: float) -> DataFrame:
    """Rows once for each of the nine cells around them (``cx``, ``cz``)."""
    near = F.array(*[F.struct((cell(x, size) + i).alias("cx"), (cell(z, size) + j).alias("cz")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumn("_c", F.explode(near)).select(*df.columns, "_c.cx", "_c.cz")


def cells(df: DataFrame, keys: list[str], x: str, z: str, size: float) -> DataFrame:
    """Distinct occupied cells by key."""
    return df.select(*keys, cell(x, size).alias("cx"), cell(z, size).alias("cz")).distinct()


def coverage(points: DataFrame, occupied: DataFrame, keys: list[str], point_id: str, x: str, z: str, size: float) -> DataFrame:
    """Share of each key's points with an occupied cell among the nine around them."""
    hit = around(points, x, z, size).join(occupied.select("cx", "cz").distinct(), ["cx", "cz"], "left_semi").select(point_id).distinct().withColumn("_hit", F.lit(1))
    out = points.join(hit, point_id, "left").groupBy(*keys)
    return out.agg(F.count("*").alias("n"), F.count("_hit").alias("hits"))


def _least(c: str) -> Column:
    """Minimum of ``c`` where nulls come first, as in a struct."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.min(c)).alias(c)


def _nearest_by_rounds(places: DataFrame, targets: DataFrame, at: list[str], reaches: list[float], t_id: str, measure: Column, fits) -> DataFrame:
    """(at, measure, t_id) of the target (at _tx, _tz) with the least ``measure`` of each place, searched within ever wider reaches.

    Places that find a target within a reach go no further, so where targets lie close together none meets all of them. ``fits(reach)``
    must hold for every target up to that reach, whatever its measure, that may be taken.
    """
    x, z = at[:2]
    left, found = places, None
    for reach in reaches:
        size = 1.001 * reach  # a little wider, so that rounding loses no target at the very reach
        near = around(left, x, z, size).join(targets.withColumns({"cx": cell("_tx", size), "cz": cell("_tz", size)}), ["cx", "cz"])
        best = near.withColumn("_m", measure).where(fits(reach)).groupBy(*at).agg(F.min(F.struct("_m", t_id)).alias("_b"))
        best = staged(best.select(*at, "_b.*"), "nearest")
        found = best if found is None else found.unionByName(best)
        if reach != reaches[-1]:
            left = staged(left.join(best, at, "left_anti"), "places")
    return found


def nearest_point(points: DataFrame, anchors: DataFrame, point_id: str, anchor_id: str, reach: float, x: str = "x", z: str = "z") -> DataFrame:
    """The nearest anchor within ``reach`` of each point; ties to the smaller anchor id. Points, and anchors, of one place are searched once."""
    places = staged(points.select(x, z).dropna().distinct(), "places")
    targets = staged(anchors.select(anchor_id, F.col(x).alias("_tx"), F.col(z).alias("_tz")).dropna(subset=["_tx", "_tz"]).groupBy("_tx", "_tz").agg(_least(anchor_id)), "anchors")
    d2 = (F.col(x) - F.col("_tx")) * (F.col(x) - F.col("_tx")) + (F.col(z) - F.col("_tz")) * (F.col(z) - F.col("_tz"))
    found = _nearest_by_rounds(places, targets, [x, z], [reach / 64, reach / 16, reach / 4, reach], anchor_id, d2, lambda r: F.col("_m") <= r * r)
    near = points.select(point_id, x, z).join(found, [x, z])
    return near.groupBy(point_id).agg(F.min(F.struct("_m", anchor_id)).alias("_b")).select(point_id, F.col(f"_b.{anchor_id}").alias(anchor_id), F.col("_b._m").alias("d2"))


def segment_distance2(px: Column, pz: Column, ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    """Squared distance of a point to a segment (clamped projection)."""
    length2 = (bx - ax) * (bx - ax) + (bz - az) * (bz - az)
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (pz - az) * (bz - az)) / length2))).otherwise(0.0)
    dx, dz = px - (ax + t * (bx - ax)), pz - (az + t * (bz - az))
    return dx * dx + dz * dz


def inside_quad(px: Column, pz: Column, corners: list[tuple[Column, Column]]) -> Column:
    """Whether a point lies in a convex polygon: all edge crosses have one sign, zero ones aside."""
    crosses = []
    for (ax, az), (bx, bz) in zip(corners, corners[1:] + corners[:1]):
        crosses.append((bx - ax) * (pz - az) - (bz - az) * (px - ax))
    none_below = crosses[0] >= 0
    none_above = crosses[0] <= 0
    for c in crosses[1:]:
        none_below, none_above = none_below & (c >= 0), none_above & (c <= 0)
    return none_below | none_above


def pairs_across(left: DataFrame, right: DataFrame, least: float = 3.0, most: float = 40.0, across_dot: float = 0.85, heading_dot: float = 0.7) -> DataFrame:
    """For each left border point (id, x, z, hx, hz) the nearest right one that faces it across the road. Points of one place and heading are searched once."""
    at, to = ["x", "z", "hx", "hz"], ["_tx", "_tz", "_thx", "_thz"]
    places = staged(left.select(*at).dropna().distinct(), "places")
    targets = right.select(F.col("id").alias("rid"), *[F.col(c).alias(t) for c, t in zip(at, to)]).dropna(subset=to)
    targets = staged(targets.groupBy(*to).agg(_least("rid")), "targets")
    dx, dz = F.col("_tx") - F.col("x"), F.col("_tz") - F.col("z")
    # the right-hand normal of heading (hx, hz) is (hz, -hx) in this plane
    facing = (F.abs(dx * F.col("hz") - dz * F.col("hx")) / F.col("_m") >= across_dot) & (F.col("hx") * F.col("_thx") + F.col("hz") * F.col("_thz") >= heading_dot)
    reaches = [most]
    while reaches[0] / 2 > least:
        reaches.insert(0, reaches[0] / 2)
    found = _nearest_by_rounds(places, targets, at, reaches, "rid", F.sqrt(dx * dx + dz * dz), lambda r: F.col("_m").between(least, r) & facing)
    near = left.select("id", *at).join(found, at)
    return near.groupBy("id").agg(F.min(F.struct("_m", "rid")).alias("_b")).select("id", "_b.rid", F.col("_b._m").alias("width"))
