"""Axle width from rides over an edge of the surface and back.

A wheel's surface changes where its contact point lies on the edge. The contact points of one wheel going out and coming back do not depend on
the width as seen along the edge, so they give its direction; each crossing of a wheel of the other side then gives the width. Crossings are found with windows over
the ticks; there are few of them, and those of a stream pass through a scan that holds the last three seconds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from statistics import median
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import windows

# Ticks of a ride; least product of headings; least length of an edge (m); tolerance of a straight edge (m); least lever of a crossing.
RIDE_TICKS, STRAIGHT, EDGE_M, LINE_M, LEVER = 180, 0.95, 1.0, 0.25, 0.3
# Plausible widths (m), rides until a width is trusted, rides kept.
WIDTHS_M, LEAST_RIDES, RIDES_KEPT = (0.8, 2.4), 3, 200
ALONG, ACROSS = (1, 1, -1, -1), (-1, 1, -1, 1)  # FL FR RL RR from the centre, in half wheelbases and half widths


def crossings(ticks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, at, wheel, was, now, x, z, fx, fz, base, surface): a row a wheel and change of its surface, half a tick back, with the heading.

    Ticks need surface (four letters), x, z, vx, vz (m/s) and wheelbase; those without surface, wheelbase or motion change nothing and are passed over.
    """
    norm = F.sqrt(F.col("vx") * F.col("vx") + F.col("vz") * F.col("vz"))
    t = ticks.where((F.length("surface") == 4) & F.col("wheelbase").isNotNull() & (norm > 0))
    t = t.withColumns({"_was": F.lag("surface").over(windows.ordered(keys, order)), "fx": F.col("vx") / norm, "fz": F.col("vz") / norm})
    t = t.where(F.col("_was") != F.col("surface"))
    letter = lambda c: F.substring(c, F.col("wheel") + 1, F.lit(1))
    t = t.withColumn("wheel", F.explode(F.array(*map(F.lit, range(4))))).withColumns({"was": letter(F.col("_was")), "now": letter(F.col("surface"))}).where("was <> now")
    half = 0.5 / 60
    return t.select(*keys, F.col(order).alias("at"), "wheel", "was", "now", (F.col("x") - F.col("vx") * half).alias("x"), (F.col("z") - F.col("vz") * half).alias("z"), "fx", "fz", F.col("wheelbase").alias("base"), "surface")


class Crossing(NamedTuple):
    at: int
    wheel: int
    was: str
    now: str
    x: float
    z: float
    fx: float
    fz: float
    base: float
    surface: str

    @property
    def axle(self) -> float:
        return ALONG[self.wheel] * self.base / 2


def ride_width(ride: list[Crossing], assumed: float) -> float | None:
    """The width that the crossings of one edge give, or None if they are no straight ride out and back by all four wheels."""
    lead = ride[0]
    if len(ride) < 4 or any(c.fx * lead.fx + c.fz * lead.fz < STRAIGHT for c in ride):
        return None
    pairs = []
    for a, b in combinations(ride, 2):
        if a.wheel == b.wheel and (a.was, a.now) == (b.now, b.was):
            ex, ez = b.x - a.x + a.axle * (b.fx - a.fx), b.z - a.z + a.axle * (b.fz - a.fz)
            pairs.append((math.hypot(ex, ez), ex, ez, a, b))
    best = max(pairs, key=lambda p: p[0], default=(0.0,))
    if best[0] <= EDGE_M:
        return None
    length, ex, ez, out, back = best
    nx, nz = ez / length, -ex / length
    centre = lambda c: nx * (c.x + c.axle * c.fx) + nz * (c.z + c.axle * c.fz)  # noqa: E731  off the line, on the car's axis
    lever = lambda c: ACROSS[c.wheel] * (nx * c.fz - nz * c.fx)  # noqa: E731  off the line by half a width
    side = ACROSS[out.wheel]
    near = [c for c in ride if ACROSS[c.wheel] == side and c is not out and c is not back]
    at = lambda c: centre(c) + lever(c) * assumed / 2
    if not near or any(abs(at(c) - at(out)) > LINE_M for c in near):
        return None  # two edges, or a curve
    wheels = [w for w in range(4) if ACROSS[w] == side]
    widths = []
    for c in ride:
        if ACROSS[c.wheel] == side or all(c.surface[w] == "T" for w in wheels):
            continue  # with the near wheels back on the road, the far ones crossed another edge
        widths += [2 * (centre(c) - centre(a)) / (lever(a) - lever(c)) for a in (out, back) if abs(lever(a) - lever(c)) >= LEVER]
    width = abs(median(widths)) if widths else math.inf
    return round(width, 3) if WIDTHS_M[0] <= width <= WIDTHS_M[1] else None


class _Rides(windows.Scan):
    """Crossings of the last three seconds by kind of edge; a ride that gives a width is spent."""

    def __init__(self, assumed: float):
        self.assumed, self.held, self.widths = assumed, [], []

    def row(self, *values) -> Iterator[tuple]:
        new = Crossing(*values)
        self.held = [c for c in self.held if new.at - c.at <= RIDE_TICKS]
        self.held.append(new)
        edge = {new.was, new.now}
        width = ride_width([c for c in self.held if {c.was, c.now} == edge], self.in_use())
        if width is not None:
            self.widths = [*self.widths, width][-RIDES_KEPT:]
            self.held = [c for c in self.held if {c.was, c.now} != edge]
            yield new.at, width

    def in_use(self) -> float:
        return median(self.widths) if len(self.widths) >= LEAST_RIDES else self.assumed


def rides(ticks: DataFrame, keys: list[str], order: str, assumed: float = 1.6) -> DataFrame:
    """(keys, at, width): every ride that gave a width, at the tick that completed it."""
    found = crossings(ticks, keys, order).withColumn("at", F.col("at").cast("long"))
    # the crossings of one tick are taken wheel by wheel
    found = found.withColumn("_order", F.struct("at", "wheel"))
    return windows.scanned(found, keys, "_order", list(Crossing._fields), "at long, width double", lambda: _Rides(assumed))


def edge_width(ticks: DataFrame, keys: list[str], order: str, assumed: float = 1.6) -> DataFrame:
    """(keys, width, rides): the median of the last rides of each key that gave a width, where there are enough."""
    r = rides(ticks, keys, order, assumed).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("at").desc()))).where(F.col("_r") <= RIDES_KEPT)
    agg = r.groupBy(*keys).agg(F.median("width").alias("_m"), F.count("*").alias("rides"))
    return agg.select(*keys, F.when(F.col("rides") >= LEAST_RIDES, F.round("_m", 3)).alias("width"), "rides")
