import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lapforge.functions import units
from lapforge.operators import calibration, engineer, identify, lifecycle, survey, tables
from lapforge.plans import catalog, racing

assert racing  # registers its queries


def circle(spark, scale):
    """1200 ticks on a circle of 120 m at a speed that swings by 10 m/s every six seconds."""
    rows, dist = [], 0.0
    for i in range(1200):
        t = i / 60
        v = 30 + 10 * math.sin(2 * math.pi * t / 6)
        dist += v / 60
        a = dist / 120
        rows.append((1, i, t, dist, v * 3.6, 120 * math.cos(a), 120 * math.sin(a), -scale * v * v / 120, scale * 10 * 2 * math.pi / 6 * math.cos(2 * math.pi * t / 6)))
    return spark.createDataFrame(rows, "lap int, i int, t double, dist double, speed double, pos_x double, pos_z double, acc_lat double, acc_long double")


@pytest.mark.parametrize(("scale", "unit"), [(1.0, "m/s^2"), (1 / 9.80665, "g")])
def test_calibration_of_a_circle(spark, scale, unit):
    got = calibration.acceleration_calibration(circle(spark, scale), ["lap"], "i").first()
    assert got["available"] and got["unit"] == unit and got["lat_fitted"] and got["long_fitted"]
    assert got["lat_slope"] == pytest.approx(-scale, rel=0.1) and got["long_slope"] == pytest.approx(scale, rel=0.1)
    assert got["lat_g"] == pytest.approx(-1 / (scale * 9.80665), rel=0.1)


def test_noise_is_not_fitted_and_few_rows_are_not_available(spark):
    noisy = circle(spark, 1.0).withColumns({"acc_lat": F.sin(F.col("i") * 12.9898) * 5, "acc_long": F.sin(F.col("i") * 78.233) * 5})
    got = calibration.acceleration_calibration(noisy, ["lap"], "i").first()
    assert not got["lat_fitted"] and not got["long_fitted"] and got["unit"] == "unverified"
    assert not calibration.acceleration_calibration(circle(spark, 1.0).where("i < 100"), ["lap"], "i").first()["available"]


def test_finish_line_heading_and_opposite_crossings(spark):
    rows = [("a", 1, 0.0, 0.0, 1.0, 0.0), ("a", 2, 2.0, 0.0, 0.0, 1.0), ("b", 1, 5.0, 5.0, 1.0, 0.0), ("b", 2, 5.0, 55.0, -1.0, 0.0)]
    c = spark.createDataFrame(rows, "k string, i int, x double, z double, hx double, hz double")
    got = {r["k"]: r for r in lifecycle.finish_line(c, ["k"], "i").collect()}
    assert (got["a"]["x"], got["a"]["hx"], got["a"]["hz"], got["a"]["confident"]) == (1.0, 0.70711, 0.70711, True)
    assert (got["b"]["hx"], got["b"]["spread"], got["b"]["confident"]) == (1.0, 25.0, False)


def test_span_verdicts_retract_a_partial_lap(spark):
    laps = spark.createDataFrame([("s", 1, 1, 2000.0, 45_000), ("s", 2, 2, 4000.0, 92_000), ("s", 3, 3, 4010.0, 90_000), ("s", 4, 4, 4005.0, 91_000), ("one", 1, 1, 10.0, 5)], "s string, i int, n int, span double, ms long")
    got = {(r["s"], r["i"]): r for r in lifecycle.span_verdicts(laps, "s", "i", "n", "span", "ms").collect()}
    assert [got["s", i]["counts"] for i in (1, 2, 3, 4)] == [False, True, True, True] and got["one", 1]["counts"]
    assert [got["s", i]["best_before"] for i in (1, 2, 3, 4)] == [None, None, 92_000, 90_000]
    assert [got["s", i]["confirmed"] for i in (1, 2, 3, 4)] == [False, False, True, True]


def test_direction_round_a_ring(spark):
    ring = [("t", j, 200 * math.cos(2 * math.pi * j / 240), 200 * math.sin(2 * math.pi * j / 240)) for j in range(240)]
    path = spark.createDataFrame(ring, "track string, j long, x double, z double")
    drive = [(lap, i, "t", 200 * math.cos(sign * 2 * math.pi * i / 400), 200 * math.sin(sign * 2 * math.pi * i / 400)) for lap, sign in (("ahead", 1), ("back", -1)) for i in range(400)]
    far = [("far", i, "t", 9000.0 + i, 0.0) for i in range(20)]
    samples = spark.createDataFrame(drive + far, "lap string, i int, track string, x double, z double")
    got = {r["lap"]: r["direction"] for r in identify.travel_direction(samples, path, ["lap"], "i", "track").collect()}
    assert got == {"ahead": 1.0, "back": -1.0, "far": 0.0}


def test_resolve_kinds_and_idempotent_evidence(spark):
    rows = [(1, 1, "auto", "me", 1, 1), (2, 1, "auto", "me", 1, 2), (3, 1, "auto", "me", 1, 2), (4, 1, "auto", "you", 7, 3), (5, 1, "edge", "me", 1, 2), (6, 2, "straddle", "me", 1, 1), (7, 2, "auto", "you", 1, 1)]
    evidence = spark.createDataFrame(rows, "i int, cell int, kind string, source string, claimed int, run int")
    votes = survey.fold_votes(evidence, ["cell"], "i")
    assert {(r["cell"], r["kind"], r["source"]): (r["votes"], r["run"]) for r in votes.collect()}[1, "auto", "me"] == (2, 2)
    kinds = survey.resolve_kinds(votes, ["cell"], ["wall", "runoff", "edge"], ["wall", "runoff", "edge", "auto", "straddle"])
    assert {r["cell"]: r["kind"] for r in kinds.collect()} == {1: "edge", 2: "auto"}


def test_resolve_kinds_ties_follow_the_order_and_then_the_name(spark):
    rows = [(p, k, "me", 4, 1) for p, ks in ((1, ("zig", "error", "click")), (2, ("zig", "error")), (3, ("add_to_cart", "auto"))) for k in ks]
    votes = spark.createDataFrame(rows, "cell int, kind string, source string, votes long, run int")
    assert {r["cell"]: r["kind"] for r in survey.resolve_kinds(votes, ["cell"], [], ["auto", "click", "add_to_cart"]).collect()} == {1: "click", 2: "error", 3: "auto"}


def test_kind_resolution_equals_sql_where_votes_tie(spark, tmp_path):
    # nine events a kind and place, so that kinds tie: error with the others at place 0, auto (refund) with add_to_cart at place 1
    rows = [(100 * p + 10 * j, j, k, 10 * p) for p, ks in ((0, ("view", "error", "click")), (1, ("refund", "add_to_cart"))) for n, k in enumerate(ks) for j in range(9)]
    rows = [(5 * i + 1, u, k, float(i), f'{{"k": {at}}}') for i, (_, u, k, at) in enumerate(rows)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES["kind_resolution"](spark, str(tmp_path)).select("place", "kind", "votes").collect())
    assert got == sorted(con.sql(catalog.ORACLE_SQL["kind_resolution"]).fetchall()) == [(0, "click", 9), (1, "add_to_cart", 9)]


def test_wheel_contacts(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0, 0.0, 30.0), (2, 0.0, 0.0, 0.0, 0.0)], "i int, x double, z double, vx double, vz double")
    got = {r["wheel"]: (r["wheel_x"], r["wheel_z"]) for r in survey.wheel_contacts(df, "x", "z", "vx", "vz", 2.6, 1.8).collect()}
    assert got == {"FL": (9.1, 21.3), "FR": (10.9, 21.3), "RL": (9.1, 18.7), "RR": (10.9, 18.7)}


def test_axle_width_from_cornering(spark):
    yaw, v, width = 0.4, 30.0, 1.82
    slow = [(1, i, 5.0, yaw, 0, 5.0, 5.0, 5.0, 5.0) for i in range(10)]
    turn = [(1, 10 + i, v, yaw, 0, v - yaw * width / 2, v + yaw * width / 2, v, v) for i in range(80)]
    braking = [(1, 90 + i, v, yaw, 200, 1.0, 1.0, 1.0, 1.0) for i in range(5)]
    df = spark.createDataFrame(slow + turn + braking, "car int, i int, speed double, yaw double, brake int, rim_fl double, rim_fr double, rim_rl double, rim_rr double")
    got = survey.axle_width(df, ["car"], "i").first()
    assert got["width"] == pytest.approx(1.82, abs=0.01) and (got["samples"], got["slow"], got["braking"]) == (80, 10, 5)
    assert survey.axle_width(df.where("i < 40"), ["car"], "i").first()["width"] is None


def test_off_road_needs_the_road_back(spark):
    states = [3] * 40 + [0] * 50 + [4] * 40 + [0] * 130 + [3] * 35
    df = spark.createDataFrame([("c", i, w, 20.0) for i, w in enumerate(states)], "k string, i int, loose int, speed double")
    assert [r["at"] for r in engineer.off_road(df, ["k"], "i", "loose", "speed").orderBy("at").collect()] == [29, 289]


def test_policies_list_specs_and_empty_tables(spark):
    table = {r["event_type"]: r for r in engineer.policies(spark).collect()}
    assert len(table) == 28 and table["fuel_critical"]["interrupts"] and table["position_lost"]["cooldown_s"] == 3
    got = spark.range(1).select(units.list_spec(F.lit(" b,x , a,b"), ["a", "b"]).alias("l")).first()["l"]
    assert got == ["b", "a"]
    none = spark.createDataFrame([], "s string, i int, n int, span double, ms long")
    assert lifecycle.span_verdicts(none, "s", "i", "n", "span", "ms").count() == 0
    assert engineer.pace_drops(none, "s", "i", "ms", F.lit(True)).count() == 0


def test_patch_and_upsert_keep_what_is_not_given(spark):
    held = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["y"])], "id int, name string, tags array<string>")
    change = spark.createDataFrame([(1, None, [])], "id int, name string, tags array<string>")
    assert {r["id"]: (r["name"], r["tags"]) for r in tables.patch(held, change, "id", ["name", "tags"]).collect()} == {1: ("a", []), 2: ("b", ["y"])}
