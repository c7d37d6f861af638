"""Window operators over ordered rows: gaps, islands, boundaries, spikes, extrema, thinning.

All take key columns and an order column; a window is partitioned by the keys, so a stream
or lap is the unit of work. Greedy scans that no window frame expresses stream sorted
partitions through a small state of each key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ordered(keys: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def upto(keys: list[str], *order: str) -> WindowSpec:
    return ordered(keys, *order).rowsBetween(Window.unboundedPreceding, 0)


def before(keys: list[str], *order: str) -> WindowSpec:
    return ordered(keys, *order).rowsBetween(Window.unboundedPreceding, -1)


def gap_frames(df: DataFrame, keys: list[str], counter: str, order: str, largest: int = 60) -> DataFrame:
    """``frames`` since the previous packet (1 to ``largest``, else 1) and ``dropped`` packets between."""
    gap = F.col(counter) - F.lag(counter).over(ordered(keys, order))
    frames = F.when(gap.between(1, largest), gap).otherwise(1)
    return df.withColumns({"frames": frames.cast("long"), "dropped": (frames - 1).cast("long")})


def integrate(df: DataFrame, keys: list[str], order: str, value: Column, out: str, skip_first: bool = False) -> DataFrame:
    """Running sum of ``value`` by key; optionally the first row adds nothing."""
    if skip_first:
        value = F.when(F.row_number().over(ordered(keys, order)) == 1, F.lit(0)).otherwise(value)
        df = df.withColumn("_v", value)
        return df.withColumn(out, F.sum("_v").over(upto(keys, order))).drop("_v")
    return df.withColumn(out, F.sum(value).over(upto(keys, order)))


def islands(df: DataFrame, keys: list[str], order: str, active: Column, min_len: int = 1) -> DataFrame:
    """Runs of consecutive rows where ``active`` holds: (keys, first, last, n) of those of ``min_len`` rows or more."""
    df = df.withColumn("_on", F.coalesce(active, F.lit(False)))
    df = df.withColumn("_start", (F.col("_on") & ~F.coalesce(F.lag("_on").over(ordered(keys, order)), F.lit(False))).cast("int"))
    df = df.withColumn("_island", F.sum("_start").over(upto(keys, order))).where("_on")
    runs = df.groupBy(*keys, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= min_len).drop("_island")


def segments(df: DataFrame, keys: list[str], order: str, starts: Column, out: str) -> DataFrame:
    """Number the stretches that begin where ``starts`` holds (the first row begins number 1)."""
    first = F.row_number().over(ordered(keys, order)) == 1
    df = df.withColumn("_s", (first | F.coalesce(starts, F.lit(False))).cast("int"))
    return df.withColumn(out, F.sum("_s").over(upto(keys, order))).drop("_s")


def changed(keys: list[str], order: str, column: str) -> Column:
    """Whether a value differs from the row before (null-safe; the first row does not)."""
    previous = F.lag(F.struct(column)).over(ordered(keys, order))
    return previous.isNotNull() & ~previous[column].eqNullSafe(F.col(column))


def spikes(df: DataFrame, keys: list[str], order: str, value: str, share: float = 0.35, reach: int = 2) -> DataFrame:
    """Rows whose value exceeds the mean of the values ``reach`` rows off by ``share`` of the key's range; of whole numbers the share is taken exactly."""
    w, all_rows = ordered(keys, order), Window.partitionBy(*keys)
    middle = (F.lag(value, reach).over(w) + F.lead(value, reach).over(w)) / 2
    df = df.withColumns({"excess": F.col(value) - middle, "_range": F.max(value).over(all_rows) - F.min(value).over(all_rows)})
    whole = isinstance(df.schema["_range"].dataType, T.IntegralType)
    least = (F.lit(Decimal(str(share))) * F.col("_range")).cast("double") if whole else share * F.col("_range")
    return df.where(F.col("excess") > least).drop("_range")


def central_difference(df: DataFrame, keys: list[str], order: str, value: str, by: Column, out: str) -> DataFrame:
    """(v[i+1] - v[i-1]) / (x[i+1] - x[i-1]); null at the ends and over no distance."""
    w = ordered(keys, order)
    df = df.withColumn("_x", by)
    dx = F.lead("_x").over(w) - F.lag("_x").over(w)
    return df.withColumn(out, (F.lead(value).over(w) - F.lag(value).over(w)) / F.nullif(dx, F.lit(0).cast("double"))).drop("_x")


def monotone(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is larger than all before them."""
    return df.withColumn("_top", F.max(value).over(before(keys, order))).where(F.col("_top").isNull() | (F.col(value) > F.col("_top"))).drop("_top")


def extrema_candidates(df: DataFrame, keys: list[str], order: str, value: str, reach: int = 30) -> DataFrame:
    """Rows that are the largest or smallest within ``reach`` rows on either side: ``kind`` peak or valley, peak first."""
    frame = ordered(keys, order).rowsBetween(-reach, reach)
    kind = F.when(F.col(value) == F.max(value).over(frame), "peak").when(F.col(value) == F.min(value).over(frame), "valley")
    place = F.row_number().over(ordered(keys, order))
    size = F.count("*").over(Window.partitionBy(*keys))
    df = df.withColumns({"kind": kind, "_place": place, "_size": size})
    return df.where((F.col("_place") > reach) & (F.col("_place") <= F.col("_size") - reach) & F.col("kind").isNotNull()).drop("_place", "_size")


def forward_fill(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.last(F.nullif(F.col(value), F.lit("")), ignorenulls=True).over(upto(keys, order)))


class Scan:
    """A scan of one key's rows in order: ``row`` takes a row's values, ``end`` ends the key; both give rows of the result."""

    def row(self, *values) -> Iterator[tuple]:
        raise NotImplementedError

    def end(self) -> Iterator[tuple]:
        return iter(())


def scanned(df: DataFrame, keys: list[str], order: str, values: list[str], schema: str, start: Callable[[], Scan]) -> DataFrame:
    """(keys, schema): every key's rows, sorted by ``order``, passed through a scan of its own.

    Partitions are sorted and streamed in batches, so what a task holds of a key is its scan, however many rows the key has.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    n_keys = len(keys)
    arrow = to_arrow_schema(T._parse_datatype_string(f"{kinds}, {schema}"))
    held = df.select(*keys, *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)], F.col(order).alias("_order"))
    held = held.repartition(*keys).sortWithinPartitions(*keys, "_order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, scan = None, None
        for batch in batches:
            out: list[tuple] = []
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            for row in zip(*columns):
                if scan is None or row[:n_keys] != key:
                    if scan is not None:
                        out += [(*key, *r) for r in scan.end()]
                    key, scan = row[:n_keys], start()
                out += [(*key, *r) for r in scan.row(*row[n_keys:])]
            yield _batch(out, arrow)
        if scan is not None:
            yield _batch([(*key, *r) for r in scan.end()], arrow)

    return held.mapInArrow(run, f"{kinds}, {schema}")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class _Thin(Scan):
    def __init__(self, least: float):
        self.least, self.last, self.i = least, None, -1

    def row(self, at):
        self.i += 1
        if self.last is None or at - self.last >= self.least:
            self.last = at
            yield float(at), self.i


def thin(df: DataFrame, keys: list[str], order: str, position: str, least: float) -> DataFrame:
    """(keys, at, row): greedy thinning: a row stays if it lies ``least`` or more past the last one kept; row is its place from 0."""
    return scanned(df, keys, order, [position], "at double, row long", lambda: _Thin(least))


class _Hysteresis(Scan):
    def __init__(self, high: float, low: float, fade: int):
        self.high, self.low, self.fade = high, low, fade
        self.open, self.sign, self.seen, self.i = None, 0, 0, -1

    def row(self, x):
        self.i += 1
        s = 1 if x > 0 else -1
        if self.open is None or (s != self.sign and abs(x) > self.high):
            if self.open is not None:
                yield self.open, self.seen, self.sign
            if abs(x) > self.high:
                self.open, self.sign, self.seen = self.i, s, self.i
        elif s == self.sign and abs(x) >= self.low:
            self.seen = self.i
        elif self.i - self.seen >= self.fade:
            yield self.open, self.seen, self.sign
            self.open = None

    def end(self):
        if self.open is not None:
            yield self.open, self.seen, self.sign


def hysteresis(df: DataFrame, keys: list[str], order: str, value: str, high: float, low: float, fade: int) -> DataFrame:
    """Signed stretches: entered above ``high``, held at ``low`` or more of the same sign, ended by the ``fade``-th row below it or by the other sign above ``high``."""
    return scanned(df, keys, order, [value], "first long, last long, sign int", lambda: _Hysteresis(high, low, fade))
