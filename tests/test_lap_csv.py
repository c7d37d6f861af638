"""Lap files: what is written comes back, torn files are refused, failed writes leave nothing."""

import os

import pytest
from pyspark.sql import functions as F

from lapforge.sources import lap_csv


@pytest.fixture(scope="module")
def tables(spark):
    laps = spark.createDataFrame([(1, 3, 61_500, "Car #7", "2026-01-02"), (2, 4, 59_004, "=HYPERLINK(1)", None), (3, 5, 1, None, "x")], "lap long, number int, time_ms long, vehicle string, finished_at string")
    rows = [(lap, i, i / 60, 0.1 * i, 100.0 + lap, None if lap == 2 else 1.5 * i) for lap in (1, 2, 9) for i in range(50)]
    return laps, spark.createDataFrame(rows, "lap long, i long, t double, dist double, speed double, steer double").repartition(7)


def test_round_trip(spark, tables, tmp_path):
    laps, ticks = tables
    at = str(tmp_path / "out")
    lap_csv.write_laps(laps, ticks, at, device="logger")
    assert sorted(os.listdir(at)) == ["lap-1.csv", "lap-2.csv"]  # lap 3 has no ticks, ticks of 9 no lap
    got = lap_csv.read_laps(spark, at)
    back = sorted(tuple(r) for r in got.where("reason is null").select("file", "i", "t", "dist", "speed", "steer", "gear").collect())
    want = sorted((f"lap-{r['lap']}.csv", r["i"], r["t"], r["dist"], r["speed"], r["steer"], None) for r in ticks.where("lap < 9").collect())
    assert [tuple((x is None, x or 0) for x in r) for r in back] == [tuple((x is None, x or 0) for x in r) for r in want]
    meta = {r["file"]: (r["vehicle"], r["comment"], r["log_date"]) for r in got.collect()}
    assert meta == {"lap-1.csv": ("Car #7", "Lap 3 - 1:01.500", "2026-01-02"), "lap-2.csv": ("'=HYPERLINK(1)", "Lap 4 - 0:59.004", "")}
    text = open(f"{at}/lap-2.csv").read().splitlines()
    assert text[0] == '"Format","MoTeC CSV File"' and text[1] == '"Device","logger"' and text[6] == "" and text[7] == '"Time","Distance","Ground Speed"' and text[8] == '"s","m","km/h"' and len(text) == 59


def test_torn_and_foreign_files_are_refused(spark, tables, tmp_path):
    laps, ticks = tables
    at = tmp_path / "out"
    lap_csv.write_laps(laps, ticks, str(at))
    whole = (at / "lap-1.csv").read_text()
    (at / "lap-a.csv").write_text(whole[:-3])
    (at / "lap-b.csv").write_text(whole[: whole.rindex(",")] + "\n")
    (at / "lap-c.csv").write_text("a,b\n1,2\n")
    (at / "lap-d.csv").write_text(whole.replace("Distance", "Dance"))
    (at / "lap-e.csv").write_text(whole.replace("0.1,", "zero,", 1))
    (at / "lap-f.csv").write_text("")
    (at / "notes.txt").write_text("not read")
    reasons = {r["file"]: r["reason"] for r in lap_csv.read_laps(spark, str(at)).where("reason is not null").collect()}
    assert reasons == {"lap-a.csv": "cut off", "lap-b.csv": "columns differ in length", "lap-c.csv": "not a lap file", "lap-d.csv": "unknown channels", "lap-e.csv": "not a number", "lap-f.csv": "cut off"}


def test_a_failed_write_publishes_nothing(spark, tables, tmp_path):
    laps, ticks = tables
    at = tmp_path / "out"
    lap_csv.write_laps(laps, ticks.where("lap = 1"), str(at))
    before = (at / "lap-1.csv").read_text()
    broken = ticks.withColumn("speed", F.when((F.col("lap") == 2) & (F.col("i") == 30), F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("speed") + 1))
    with pytest.raises(Exception):
        lap_csv.write_laps(laps, broken, str(at), mode="overwrite")
    assert os.listdir(at) == ["lap-1.csv"] and (at / "lap-1.csv").read_text() == before
    lap_csv.write_laps(laps, ticks.where("lap = 2"), str(at), mode="overwrite")
    assert os.listdir(at) == ["lap-2.csv"]
