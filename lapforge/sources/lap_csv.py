"""Laps as CSV files that analysis tools read, as a Python data source: a file a lap, written by tasks and published on commit.

``write_laps`` brings the ticks of a lap together, in order, and each task streams its laps to files of its own in a hidden folder beside the target; the driver moves
those of the attempts that succeeded into place, so a failed or repeated task leaves nothing behind. ``read_laps`` reads a folder, a partition a file; a
file that is cut off or not of this form gives one row with the reason. The folder must be one that driver and executors share as a mounted path.
"""

from __future__ import annotations

import csv
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lapforge.functions import text

# Channels of the file format, with their display names and units.
CHANNELS = [
    ("t", "Time", "s"), ("dist", "Distance", "m"), ("speed", "Ground Speed", "km/h"), ("throttle", "Throttle Pos", "%"), ("brake", "Brake Pos", "%"), ("gear", "Gear", ""), ("rpm", "Engine RPM", "rpm"),
    ("boost", "Boost Pressure", "bar"), ("tire_slip", "Tyre Slip Ratio", ""), ("yaw_rate", "Yaw Rate", "rad/s"), ("pos_x", "Pos X", "m"), ("pos_z", "Pos Z", "m"), ("body_height", "Ride Height", "mm"), ("fuel", "Fuel Level", "L"),
    ("slip_fl", "Tyre Slip FL", ""), ("slip_fr", "Tyre Slip FR", ""), ("slip_rl", "Tyre Slip RL", ""), ("slip_rr", "Tyre Slip RR", ""),
    ("tt_fl", "Tyre Temp FL", "C"), ("tt_fr", "Tyre Temp FR", "C"), ("tt_rl", "Tyre Temp RL", "C"), ("tt_rr", "Tyre Temp RR", "C"),
    ("sus_fl", "Susp Travel FL", "mm"), ("sus_fr", "Susp Travel FR", "mm"), ("sus_rl", "Susp Travel RL", "mm"), ("sus_rr", "Susp Travel RR", "mm"),
    ("aids", "Driver Aids", ""), ("surface", "Surface Mask", ""), ("steer", "Steering Angle", "rad"), ("acc_lat", "Accel Lateral", ""), ("acc_long", "Accel Longitudinal", ""), ("acc_vert", "Accel Vertical", ""),
    ("throttle_f", "Throttle Applied", "%"), ("brake_f", "Brake Applied", "%"), ("race_pos", "Race Position", ""),
]
FORMAT, RATE = "MoTeC CSV File", "60.000"
META = ("Format", "Device", "Vehicle", "Comment", "Log Date", "Sample Rate")
NAMES = [c for c, _, _ in CHANNELS]
READ = "file string, vehicle string, comment string, log_date string, i long, " + ", ".join(f"{c} double" for c in NAMES) + ", reason string"
PREFIX = "lap-"


@dataclass
class LapFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


def _number(value: float) -> str:
    return repr(float(value))


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, device: str, columns: list[str]):
        self.path, self.overwrite, self.device, self.columns = path, overwrite, device, columns
        self.pending = os.path.join(path, f".pending-{uuid.uuid4().hex}")

    def write(self, rows: Iterator) -> Written:
        own = os.path.join(self.pending, uuid.uuid4().hex)  # of this attempt
        os.makedirs(own, exist_ok=True)
        files = []
        for lap, ticks in groupby(rows, key=lambda r: r["lap"]):
            name = f"{PREFIX}{lap}.csv"
            with open(os.path.join(own, name), "w", encoding="utf-8", newline="") as f:
                self._one(f, ticks)
            files.append(name)
        return Written(own, files)

    def _one(self, f, ticks: Iterator) -> None:
        quoted, plain = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\n"), csv.writer(f, lineterminator="\n")
        shown = None
        for row in ticks:
            if shown is None:
                shown = [c for c in CHANNELS if c[0] in self.columns and row[c[0]] is not None]  # a lap carries a channel from its first tick or not at all
                for entry in zip(META, (FORMAT, self.device, row["vehicle"] or "", row["comment"] or "", row["log_date"] or "", RATE)):
                    quoted.writerow(entry)
                f.write("\n")
                quoted.writerow([name for _, name, _ in shown])
                quoted.writerow([unit for _, _, unit in shown])
            plain.writerow(["" if row[c] is None else _number(row[c]) for c, _, _ in shown])

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for name in os.listdir(self.path):
                if name.startswith(PREFIX) and name.endswith(".csv"):
                    os.remove(os.path.join(self.path, name))
        for m in messages:
            for name in m.files if m else ():
                os.replace(os.path.join(m.folder, name), os.path.join(self.path, name))
        shutil.rmtree(self.pending, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[LapFile]:
        names = sorted(n for n in os.listdir(self.path) if n.startswith(PREFIX) and n.endswith(".csv"))
        return [LapFile(os.path.join(self.path, n)) for n in names]

    def read(self, partition: LapFile) -> Iterator[tuple]:
        name, none = os.path.basename(partition.path), (None,) * len(NAMES)
        try:
            rows = list(parse(partition.path))  # a lap's ticks: nothing of a file counts unless all of it does
        except ValueError as why:
            rows = [(None, None, None, None, *none, str(why))]
        for row in rows:
            yield (name, *row)


def parse(path: str) -> Iterator[tuple]:
    """(vehicle, comment, log date, i, channels, None) of every tick; a ValueError says what is wrong."""
    with open(path, encoding="utf-8", newline="") as f:
        whole = f.read()
    if not whole.endswith("\n"):
        raise ValueError("cut off")
    lines = list(csv.reader(whole.splitlines()))
    if len(lines) < len(META) + 3 or [r[:1] for r in lines[: len(META)]] != [[m] for m in META] or lines[0][1:] != [FORMAT] or lines[len(META)] or any(len(r) != 2 for r in lines[: len(META)]):
        raise ValueError("not a lap file")
    meta = [r[1] for r in lines[: len(META)]]
    shown, units = lines[len(META) + 1], lines[len(META) + 2]
    known = {(name, unit): c for c, name, unit in CHANNELS}
    if len(shown) != len(units) or any(pair not in known for pair in zip(shown, units)):
        raise ValueError("unknown channels")
    at = [known[pair] for pair in zip(shown, units)]
    for i, row in enumerate(lines[len(META) + 3 :]):
        if len(row) != len(at):
            raise ValueError("columns differ in length")
        try:
            values = {c: float(v) if v else None for c, v in zip(at, row)}
        except ValueError:
            raise ValueError("not a number") from None
        yield (meta[2], meta[3], meta[4], i, *[values.get(c) for c in NAMES], None)


class LapCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lap_csv"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        os.makedirs(self.options["path"], exist_ok=True)
        return Writer(self.options["path"], overwrite, self.options.get("device", ""), schema.names)


def write_laps(laps: DataFrame, ticks: DataFrame, path: str, device: str = "", mode: str = "append") -> None:
    """Write a file a lap: laps (lap, number, time_ms, vehicle, finished_at), ticks (lap, i, channels).

    A tick without a lap is not written; text that a spreadsheet would take for a formula gets a leading quote.
    """
    laps.sparkSession.dataSource.register(LapCsv)
    ms = F.col("time_ms").cast("long")
    took = F.concat(F.floor(ms / 60000).cast("string"), F.lit(":"), F.lpad(F.format_string("%.3f", ms % 60000 / 1000), 6, "0"))
    guarded = lambda c: text.csv_guard(F.coalesce(c, F.lit("")))
    head = laps.select("lap", guarded(F.col("vehicle")).alias("vehicle"), guarded(F.concat(F.lit("Lap "), F.col("number"), F.lit(" - "), took)).alias("comment"), guarded(F.col("finished_at").cast("string")).alias("log_date"))
    shown = [F.col(c).cast("double").alias(c) for c in NAMES if c in ticks.columns]
    rows = ticks.select("lap", "i", *shown).join(head, "lap")
    rows.repartition("lap").sortWithinPartitions("lap", "i").write.format("lap_csv").option("device", device).mode(mode).save(path)


def read_laps(spark: SparkSession, path: str) -> DataFrame:
    """(file, vehicle, comment, log_date, i, channels, reason): a row a tick, or one with the reason of a file that is refused."""
    spark.dataSource.register(LapCsv)
    return spark.read.format("lap_csv").load(path)
