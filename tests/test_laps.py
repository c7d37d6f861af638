import math

from pyspark.sql import Row
from pyspark.sql import functions as F

from lapforge.operators import align, corners, detectors, laps, stats, windows
from lapforge.plans import telemetry


def packet(i, lap, **kw):
    base = {"console": "a", "packet_id": i, "current_lap": lap, "car_id": 7, "on_track": True, "paused": False, "speed": 180.0, "throttle": 100.0, "brake": 0.0, "fuel": 100.0, "last_lap_time_ms": -1}
    base |= {f"slip_{w}": 1.0 for w in laps.WHEELS} | {f"sus_{w}": 30.0 for w in laps.WHEELS}
    return Row(**(base | kw))


def test_lap_by_packets(spark):
    rows = [packet(i, 1) for i in range(120)] + [packet(120, 2, last_lap_time_ms=61_500, fuel=98.0)]
    df = spark.createDataFrame(rows)
    done = laps.completed(df, min_ticks=100).collect()
    assert [(r["lap"], r["time_ms"], r["ticks"]) for r in done] == [(1, 61_500, 120)]
    m = laps.metrics(laps.ticks(df), ["console", "session", "current_lap"]).where("current_lap = 1").first()
    assert m["ticks"] == 120 and m["full_throttle_pct"] == 100 and m["max_speed"] == 180
    assert abs(m["length_m"] - 100) < 1e-6  # the first step counts for distance


def test_sessions_start_on_car_change_and_counter_fall(spark):
    rows = [packet(0, 1), packet(1, 2), packet(2, 1), packet(3, 1, car_id=8), packet(4, 1, car_id=8)]
    got = [r["session"] for r in laps.sessions(spark.createDataFrame(rows)).orderBy("packet_id").collect()]
    assert got == [1, 1, 2, 3, 3]


def test_a_dropped_packet_widens_one_step(spark):
    rows = [packet(i, 1) for i in (0, 1, 4, 5)]
    t = [r["t"] for r in laps.ticks(spark.createDataFrame(rows)).orderBy("i").collect()]
    assert [round(x * 60) for x in t] == [0, 1, 4, 5]


def test_lockup_and_wheelspin_once(spark):
    rows = [packet(i, 1, brake=50.0 if 20 <= i < 30 else 0.0, slip_fl=0.7 if 20 <= i < 30 else 1.0, slip_rr=1.3 if 60 <= i < 70 else 1.0) for i in range(100)]
    got = laps.slip_events(laps.ticks(spark.createDataFrame(rows)), ["console", "session", "current_lap"]).collect()
    assert sorted((r["type"], r["first"], r["last"], r["severity"]) for r in got) == [("lockup", 20, 29, 0.7), ("wheelspin", 60, 69, 1.3)]


def test_bottoming_and_kerb(spark):
    rows = [packet(i, 1, sus_fl=60.0 if 40 <= i < 45 else 30.0 + (i % 2), sus_rr=70.0 if i == 80 else 30.0) for i in range(100)]
    got = laps.suspension_events(laps.ticks(spark.createDataFrame(rows)), ["console", "session", "current_lap"]).collect()
    kinds = {(r["type"], r["wheel"]) for r in got}
    assert ("bottoming", "fl") in kinds and ("kerb", "rr") in kinds


def test_suspension_events_of_a_long_lap_are_all_given(spark):
    high = lambda i: i % 20 in (8, 9, 10)
    rows = [packet(i, 1, sus_fl=60.0 if high(i) else 30.0, sus_rl=70.0 if i % 10 == 5 else 30.0, sus_rr=70.0 if i % 20 == 15 else 30.0) for i in range(1200)]
    got = laps.suspension_events(laps.ticks(spark.createDataFrame(rows)), ["console", "session", "current_lap"]).collect()
    bottoming = [("fl", i, i + 2) for i in range(8, 1200, 20)]
    strikes = [("rl", i, i) for i in range(5, 1200, 10)] + [("rr", i, i) for i in range(15, 1200, 20)]
    assert sorted((r["wheel"], r["first"], r["last"]) for r in got if r["type"] == "bottoming") == bottoming
    assert [x for x in sorted((r["wheel"], r["first"], r["last"]) for r in got if r["type"] == "kerb") if x[0] != "fl"] == sorted(strikes)


def test_ticks_of_few_bytes_are_spread_over_tasks(spark):
    ticks = telemetry._ticks(spark, "/root/testdata/sf0.001")
    assert ticks.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_race_result(spark):
    rows = [packet(i, lap, race_position=pos, total_positions=8, total_laps=2) for i, (lap, pos) in enumerate([(1, 5), (2, 4), (2, 3), (3, -1), (3, 2)])]
    r = laps.race_result(spark.createDataFrame(rows), ["console"], "packet_id").first()
    assert (r["packet_id"], r["final_position"], r["race_laps"]) == (3, 3, 2)


def test_delta_of_constant_speeds(spark):
    rows = [(lap, d, d / v) for lap, v in (("ref", 50.0), ("slow", 40.0)) for d in [10.0 * i for i in range(101)]]
    out = align.delta(spark.createDataFrame(rows, "lap string, dist double, t double"), "lap", "dist", "t", "ref", 5.0)
    last = out.orderBy("dist").collect()[-1]
    assert last["dist"] == 1000 and abs(last["delta_ms"] - 5000) < 1e-6


def path(*parts):
    x = z = heading = dist = 0.0
    rows = [(0.0, 0.0, 0.0, 100.0)]
    for length, angle in parts:
        for _ in range(int(length / 2)):
            heading += math.radians(angle) / int(length / 2)
            x, z, dist = x + 2 * math.cos(heading), z + 2 * math.sin(heading), dist + 2
            rows.append((dist, x, z, 100.0 - abs(angle) / 2))
    return rows


def found(spark, *parts):
    df = spark.createDataFrame([("l", i, *r) for i, r in enumerate(path(*parts))], "lap string, i long, dist double, pos_x double, pos_z double, speed double")
    return corners.detect(df, ["lap"]).orderBy("n").collect()


def test_corners(spark):
    assert found(spark, (600, 0)) == []
    one = found(spark, (300, 0), (120, 90), (300, 0))
    assert [(c["n"], c["direction"]) for c in one] == [(1, "R")] and abs(one[0]["angle_deg"] - 90) < 12 and abs(one[0]["apex_dist"] - 360) < 20
    assert [c["direction"] for c in found(spark, (300, 0), (100, 80), (100, -80), (300, 0))] == ["R", "L"]
    assert [c["direction"] for c in found(spark, (300, 0), (60, 80), (30, 4), (60, 80), (300, 0))] == ["R"]


def test_corner_report_takes_both_ends_of_a_wrapped_corner(spark):
    ticks = spark.createDataFrame([("l", i, 10.0 * i, float(i), 100.0 - i, 0.0) for i in range(11)], "lap string, i long, dist double, t double, speed double, brake double")
    cs = spark.createDataFrame([(1, 20.0, 50.0), (2, 90.0, 10.0)], "n int, entry_dist double, exit_dist double")
    got = {r["corner"]: (r["min_speed"], r["time_s"]) for r in corners.report(ticks.withColumn("track", F.lit(1)), cs.withColumn("track", F.lit(1)), ["lap"], ["track"]).collect()}
    assert got == {1: (96.0, 2.0), 2: (90.0, 1.0)}


def test_corner_report_leaves_out_what_the_lap_never_finished(spark):
    ticks = spark.createDataFrame([("l", i, 10.0 * i, float(i), 50.0, 1.0) for i in range(7)], "lap string, i long, dist double, t double, speed double, brake double")
    cs = spark.createDataFrame([(1, 20.0, 50.0), (2, 40.0, 61.5), (3, 50.0, 70.0), (4, 90.0, 10.0)], "n int, entry_dist double, exit_dist double")
    got = {r["corner"]: r["time_s"] for r in corners.report(ticks.withColumn("track", F.lit(1)), cs.withColumn("track", F.lit(1)), ["lap"], ["track"]).collect()}
    assert got == {1: 2.0, 2: 2.0, 4: 0.0}


def test_the_first_row_weighs_what_the_second_does(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 2.0), ("a", 2, 1.5), ("b", 0, 7.0)], "lap string, i long, t double")
    got = {(r["lap"], r["i"]): r["weight"] for r in stats.time_weights(df, ["lap"], "i", "t").collect()}
    assert got == {("a", 0): 2.0, ("a", 1): 2.0, ("a", 2): 0.0, ("b", 0): 1.0}


def test_scans_keep_to_their_key_across_batches(spark):
    rows = [(k, i, float(i * (k or 3))) for k in (1, 2, None, 5) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, i long, x double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a key spans batches, and a batch keys
    got = sorted((r["k"] or 0, r["at"], r["row"]) for r in windows.thin(df, ["k"], "i", "x", 20.0).collect())
    want = []
    for k in {r[0] for r in rows}:
        last = None
        for n, x in enumerate(x for kk, _, x in rows if kk == k):
            if last is None or x - last >= 20:
                last = x
                want.append((k or 0, x, n))
    assert got == sorted(want)
    waves = spark.createDataFrame([(1, i, math.sin(i / 4) * 60) for i in range(120)], "k int, i long, x double")
    signs = [(r["first"], r["last"], r["sign"]) for r in windows.hysteresis(waves, ["k"], "i", "x", 40.0, 20.0, 3).orderBy("first").collect()]
    assert all(abs(math.sin(a / 4) * 60) > 40 and abs(math.sin(b / 4) * 60) >= 20 for a, b, _ in signs) and [s for *_, s in signs] == [1 if i % 2 == 0 else -1 for i in range(len(signs))]
    said = spark.createDataFrame([("u", i, t, s) for i, (t, s) in enumerate([(0.0, 1), (5.0, 1), (6.0, 2), (9.0, 2), (None, 9), (20.0, None), (16.0, 0), (30.0, 0)])], "u string, i long, t double, s int")
    assert [(r["at"], r["severity"]) for r in detectors.rate_limited(said, ["u"], "i", "t", "s", 10.0).orderBy("at").collect()] == [(0.0, 1), (6.0, 2), (16.0, 0), (30.0, 0)]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
