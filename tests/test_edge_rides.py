"""Axle width from edge rides: planted widths are found, what is no ride is refused."""

import math

import pytest
from pyspark.sql import functions as F

from lapforge.operators import edge_rides

SCHEMA = "car int, at long, surface string, x double, z double, vx double, vz double, wheelbase double"
WHEELS = ((1, -1), (1, 1), (-1, -1), (-1, 1))


def drive(car, plan, off, width, base=2.6, speed=40.0):
    """Ticks of a plan of (heading, ticks); ``off`` gives the letter of the ground at a place."""
    rows, x, z, at = [], 0.0, 0.0, 0
    for heading, n in plan:
        fx, fz = math.cos(heading), math.sin(heading)
        for _ in range(n):
            at, x, z = at + 1, x + fx * speed / 60, z + fz * speed / 60
            ground = "".join(off(x + a * base / 2 * fx + b * width / 2 * fz, z + a * base / 2 * fz - b * width / 2 * fx) for a, b in WHEELS)
            rows.append((car, at, ground, x, z, speed * fx, speed * fz, base))
    return rows


def out_and_back(rides, angle=math.radians(6)):
    return [step for _ in range(rides) for step in ((angle, 60), (-angle, 60), (0.0, 40))]


KERB = lambda x, z: "C" if z > 1.0 else "T"
LANE = lambda x, z: "G" if z > 1.2 or z < -1.2 else "T"


@pytest.fixture(scope="module")
def ticks(spark):
    rows = []
    for car, width in ((1, 1.5), (2, 1.9), (3, 1.2)):
        rows += drive(car, out_and_back(4), KERB, width)
    rows += drive(4, out_and_back(2), KERB, 1.5)  # too few rides to trust
    stripe = lambda x, z: "G" if 4 < (x + z) / math.sqrt(2) < 8 else "T"
    rows += drive(5, [(0.0, 260)], stripe, 1.5, speed=5.0)
    weave = [(0.08, 25), (-0.08, 50), (0.08, 50), (-0.08, 50), (0.08, 25)]  # the left wheels leave on the left, the right ones on the right
    rows += drive(6, weave, LANE, 1.5)
    rows += drive(7, [(0.0, 300)], KERB, 1.5)  # never leaves the road
    turn = lambda x, z: "C" if math.hypot(x - 20, z) > 20 else "T"
    rows += drive(8, [(0.3 * i, 30) for i in range(12)], turn, 1.5)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_planted_widths_are_found(ticks):
    got = {r["car"]: (r["width"], r["rides"]) for r in edge_rides.edge_width(ticks, ["car"], "at", 1.7).collect()}
    for car, width in ((1, 1.5), (2, 1.9), (3, 1.2)):
        assert got[car][1] >= 3 and abs(got[car][0] - width) < 0.15
    assert got[4][0] is None and got[4][1] >= 1
    assert not {5, 6, 7, 8} & set(got)


def test_crossings_lie_on_the_edge(ticks):
    rows = edge_rides.crossings(ticks.where("car = 1"), ["car"], "at").collect()
    assert len(rows) == 4 * 8  # every wheel goes out and comes back in each of the four rides
    for r in rows:
        a, b = WHEELS[r["wheel"]]
        edge = r["z"] + a * 1.3 * r["fz"] - b * 0.75 * r["fx"]
        assert abs(edge - 1.0) < 0.08


def test_the_direction_of_travel_does_not_matter(spark, ticks):
    turned = ticks.where("car <= 3").withColumns({"x": -F.col("x"), "z": -F.col("z"), "vx": -F.col("vx"), "vz": -F.col("vz")})
    a = {(r["car"], r["at"]): r["width"] for r in edge_rides.rides(ticks.where("car <= 3"), ["car"], "at").collect()}
    b = {(r["car"], r["at"]): r["width"] for r in edge_rides.rides(turned, ["car"], "at").collect()}
    assert a == pytest.approx(b) and len(a) >= 9


def test_ticks_without_data_are_passed_over(spark, ticks):
    base = {(r["at"], r["width"]) for r in edge_rides.rides(ticks.where("car = 1"), ["car"], "at").collect()}
    more = spark.createDataFrame([(1, 10_000, "CTCT", 0.0, 0.0, 0.0, 0.0, 2.6), (1, 10_001, None, 0.0, 0.0, 1.0, 0.0, 2.6), (1, 10_002, "CTCT", 0.0, 0.0, 1.0, 0.0, None)], SCHEMA)
    assert {(r["at"], r["width"]) for r in edge_rides.rides(ticks.where("car = 1").unionByName(more), ["car"], "at").collect()} == base
    assert edge_rides.edge_width(ticks.limit(0), ["car"], "at").count() == 0


def test_query_finds_the_widths_of_all_cars(spark):
    from lapforge.plans import telemetry

    sf = "/root/testdata/sf0.01"
    got = telemetry.edge_ride_widths(spark, sf).collect()
    assert len({r["user_id"] for r in got}) > 40  # the ticks are four metres apart, so many rides miss the tolerance of a straight edge
    off = sorted(abs(r["width"] - 2 * (0.6 + r["user_id"] % 8 / 20)) for r in got)
    assert off[len(off) // 2] < 0.2
