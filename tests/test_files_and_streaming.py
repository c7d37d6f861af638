import json

from pyspark.sql import functions as F

from lapforge.operators import detectors
from lapforge.plans import catalog
from lapforge.sources import files
from lapforge.streaming import clock

DATA = "/root/testdata/sf0.001"


def test_lap_files(spark, tmp_path):
    samples = {c: [0.0, 1.0, 2.0] for c in files.REQUIRED}
    good = {"format": "lap", "version": 2, "lap": {"number": 3, "time_ms": 61500, "car_id": 7, "samples": samples}}
    short = json.loads(json.dumps(good))
    short["lap"]["samples"]["coast"] = [1.0]
    lacking = json.loads(json.dumps(good))
    del lacking["lap"]["samples"]["body_height"]
    unnamed = {**good, "version": None}
    untimed = {**good, "lap": {**good["lap"], "time_ms": None}}
    for name, doc in (("a", good), ("b", short), ("c", lacking), ("d", unnamed), ("e", untimed), ("f", {**good, "format": "car"}), ("g", {**good, "format": None})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    laps = files.read_laps(spark, str(tmp_path))
    reasons = {r["file"][-6:-5]: r["reason"] for r in laps.collect()}
    assert reasons == {"a": None, "b": "columns differ in length", "c": "missing columns: body_height", "d": "unknown version", "e": "bad lap number or time", "f": "not a lap file", "g": "not a lap file"}
    assert files.ticks(laps).count() == 3
    one = laps.where("reason is null").first()
    assert (one["car_id"], one["finished_at"], one["min_oil_pressure"], one["fuel_end"]) == (7, "", -1.0, 0.0)
    told = laps.where("reason is null").withColumn("fuel_end", F.lit(31.5)).withColumn("lap_id", F.lit(1))
    out = files.lap_json(told, files.ticks(laps).withColumn("lap_id", F.lit(1)).drop("file"), format_name="other").first()["json"]
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / "x.json").write_text(out)
    back = files.read_laps(spark, str(tmp_path / "again"), ("other",)).first()
    assert back["reason"] is None and back["fuel_end"] == 31.5 and back["car_id"] == 7 and list(back["samples"]["t"]) == [0.0, 1.0, 2.0]


def test_cars_and_logs(spark, tmp_path):
    (tmp_path / "cars.csv").write_text("id,name\n1,One\nx,Bad\n1,Uno\n2,Two\n")
    cars = files.read_cars(spark, str(tmp_path / "cars.csv"))
    named = files.with_car_names(spark.createDataFrame([(1,), (9,)], "car_id int"), cars).orderBy("car_id").collect()
    assert [r["car_name"] for r in named] == ["Uno", "Car #9"]
    (tmp_path / "log.jsonl").write_text('{"meta":{"version":1}}\n{"track":"A"}\n{"mark":"wall","x":1.0,"z":2.0,"side":"L"}\n{"track":"B"}\n{"changed":[1]}\n{"mar')
    s = files.summarize_logs(files.read_survey_logs(spark, str(tmp_path / "log.jsonl"))).first()
    assert (s["marks"], s["transitions"], s["torn"], s["label"]) == (1, 1, 1, "B")


def run(query, spark, name, checkpoint):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    src = catalog.events(spark, DATA).select("user_id", "event_id", "k", (F.col("us") / 1e6).alias("t"))
    src.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    got = run(clock.sustained(stream, "user_id", "t", "k", 60, 40, 600), spark, "held", tmp_path / "c1")
    want = detectors.sustained(src, ["user_id"], "event_id", "k", "t", 60, 40, 600)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    ticks = run(clock.packet_clock(stream, "user_id", "event_id"), spark, "ticks", tmp_path / "c2").collect()
    assert len(ticks) == src.count()
    one = sorted((r["event_id"], r["frames"]) for r in ticks if r["user_id"] == ticks[0]["user_id"])
    total, last = 0, None
    for c, frames in one:
        total += 1 if last is None or not 1 <= c - last <= 60 else c - last
        last = c
        assert frames == total
