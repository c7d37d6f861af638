"""Interchange files: lap envelopes (JSON), car lists (CSV), survey logs (JSON lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sample columns of a lap file, the first ten of which are required.
REQUIRED = ["t", "dist", "speed", "throttle", "brake", "coast", "tire_slip", "body_height", "pos_x", "pos_z"]
OPTIONAL = ["gear", "rpm", "fuel", "boost", "yaw_rate", "steer", "acc_lat", "acc_long", "acc_vert", "race_pos"]
MAX_SAMPLES = 120_000
# What a lap file tells of a lap besides, and what stands for it where it is missing.
ABOUT = [("finished_at", "string", ""), ("car_id", "int", 0), ("fuel_start", "double", 0.0), ("fuel_end", "double", 0.0), ("max_water_temp", "double", 0.0), ("max_oil_temp", "double", 0.0), ("min_oil_pressure", "double", -1.0)]
LAP = "format string, version int, lap struct<number int, time_ms long, " + ", ".join(f"{c} {t}" for c, t, _ in ABOUT) + ", samples struct<" + ", ".join(f"{c} array<double>" for c in REQUIRED + OPTIONAL) + ">>"


def read_laps(spark: SparkSession, path: str, formats: tuple[str, ...] = ("lap",)) -> DataFrame:
    """Lap files, one row a file: (file, number, time_ms, columns of ABOUT, samples, reason); reason is null for a valid lap.

    ``formats`` are the names that a lap file may give itself.
    """
    raw = spark.read.schema(LAP).json(path, multiLine=True).withColumn("file", F.input_file_name())
    s = F.col("lap.samples")
    n = F.size(s["t"])
    same = F.lit(True)
    finite = F.lit(True)
    for c in REQUIRED + OPTIONAL:
        same = same & (s[c].isNull() | (F.size(s[c]) == n))
        finite = finite & F.coalesce(F.forall(s[c], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(True))
    missing = F.array_compact(F.array(*[F.when(s[c].isNull(), F.lit(c)) for c in REQUIRED]))
    reason = (
        F.when(F.col("lap").isNull() | ~F.coalesce(F.col("format").isin(*formats), F.lit(False)), "not a lap file")
        .when(~F.coalesce(F.col("version").isin(1, 2), F.lit(False)), "unknown version")
        .when(~F.coalesce((F.col("lap.number") >= 0) & (F.col("lap.time_ms") > 0), F.lit(False)), "bad lap number or time")
        .when(F.size(missing) > 0, F.concat(F.lit("missing columns: "), F.array_join(missing, ", ")))
        .when((n < 1) | (n > MAX_SAMPLES), "bad number of samples")
        .when(~same, "columns differ in length")
        .when(~finite, "samples are not finite")
    )
    about = [F.coalesce(F.col(f"lap.{c}"), F.lit(default)).alias(c) for c, _, default in ABOUT]
    return raw.select("file", "lap.number", "lap.time_ms", *about, s.alias("samples"), reason.alias("reason"))


def ticks(laps: DataFrame) -> DataFrame:
    """Valid laps as one row a sample: (file, i, columns)."""
    absent = F.array().cast("array<double>")
    parts = F.arrays_zip(*[F.coalesce(F.col(f"samples.{c}"), absent).alias(c) for c in REQUIRED + OPTIONAL])
    out = laps.where("reason is null").select("file", F.posexplode(parts).alias("i", "_s"))
    return out.select("file", "i", *[F.col("_s").getField(c).alias(c) for c in REQUIRED + OPTIONAL])


def lap_json(laps: DataFrame, ticks_: DataFrame, key: str = "lap_id", format_name: str = "lap") -> DataFrame:
    """(key, json): lap envelopes of version 2, samples in order, with those columns of ABOUT that ``laps`` has."""
    cols = [c for c in ticks_.columns if c not in (key, "i")]
    rows = ticks_.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", *cols))).alias("_r"))  # a lap has at most MAX_SAMPLES rows
    # a channel that a lap does not carry from start to end is left out: filled up, it would tell of what was never measured
    samples = F.struct(*[F.when(F.forall(F.col(f"_r.{c}"), lambda x: x.isNotNull()), F.col(f"_r.{c}")).alias(c) for c in cols])
    lap = F.struct("number", "time_ms", *[c for c, *_ in ABOUT if c in laps.columns], samples.alias("samples"))
    out = laps.join(rows, key)
    return out.select(key, F.to_json(F.struct(F.lit(format_name).alias("format"), F.lit(2).alias("version"), lap.alias("lap"))).alias("json"))


def read_cars(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of a car list; malformed rows are skipped, of a repeated id the last name counts."""
    rows = spark.read.csv(path, header=True).withColumn("_n", F.monotonically_increasing_id())
    rows = rows.select(F.expr("try_cast(id as int)").alias("id"), F.trim("name").alias("name"), "_n").where("id is not null and name is not null")
    return rows.groupBy("id").agg(F.max_by("name", "_n").alias("name"))


def with_car_names(df: DataFrame, cars: DataFrame, car: str = "car_id") -> DataFrame:
    named = df.join(cars.select(F.col("id").alias(car), F.col("name").alias("car_name")), car, "left")
    return named.withColumn("car_name", F.coalesce("car_name", F.concat(F.lit("Car #"), F.col(car).cast("string"))))


def read_survey_logs(spark: SparkSession, path: str) -> DataFrame:
    """Records of survey logs, one row a line: (file, line, kind, x, z, side, label); torn lines have kind 'torn'."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).withColumn("line", F.monotonically_increasing_id())
    rec = F.from_json("value", "meta struct<version int>, track string, mark string, finish boolean, changed array<int>, x double, z double, side string")
    kind = (
        F.when(rec["meta"].isNotNull(), "meta").when(rec["track"].isNotNull(), "track").when(rec["mark"].isNotNull(), "mark")
        .when(rec["finish"].isNotNull(), "finish").when(rec["changed"].isNotNull(), "transition").otherwise("torn")
    )
    return lines.select("file", "line", kind.alias("kind"), rec["x"].alias("x"), rec["z"].alias("z"), rec["side"].alias("side"), rec["track"].alias("label"))


def summarize_logs(records: DataFrame) -> DataFrame:
    """(file, marks, finishes, transitions, torn, label): counts of records, and the last label."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return records.groupBy("file").agg(
        count("mark").alias("marks"), count("finish").alias("finishes"), count("transition").alias("transitions"), count("torn").alias("torn"),
        F.max_by(F.col("label"), F.when(F.col("label").isNotNull(), F.col("line"))).alias("label"),
    )
