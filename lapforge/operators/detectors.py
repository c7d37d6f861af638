"""Debounced, sustained and rate-limited detectors over ordered streams.

Where a rule is a run of equal values or a threshold it is windows over islands; where each
decision depends on the last one, sorted rows stream through a small state of each key, and
``lapforge.streaming`` keeps the same state between micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import Scan, changed, ordered, scanned, segments, upto


def debounced_changes(df: DataFrame, keys: list[str], order: str, value: str, hold: int) -> DataFrame:
    """Changes of a value that then holds for ``hold`` further rows: (keys, at, old, new), ``at`` being the row that ends the hold.

    The first value is the baseline, held or not; a value that goes before it was held changes nothing.
    """
    runs = segments(df.where(F.col(value).isNotNull()), keys, order, changed(keys, order, value), "_run")
    nth = F.row_number().over(ordered([*keys, "_run"], order))
    runs = runs.withColumn("_nth", nth).groupBy(*keys, "_run").agg(F.min(F.when(F.col("_nth") == hold + 1, F.col(order))).alias("at"), F.first(value).alias("new"))
    runs = runs.where(F.col("at").isNotNull() | (F.col("_run") == 1)).withColumn("old", F.lag("new").over(ordered(keys, "_run")))
    return runs.where(F.col("old") != F.col("new")).select(*keys, "at", "old", "new")


def sustained_state(df: DataFrame, keys: list[str], order: str, value: str, clock: str, trigger: float, clear: float, hold: float, above: bool = True) -> DataFrame:
    """Add ``active``: a value has been at ``trigger`` or more for ``hold`` clock units, and not under ``clear`` since.

    ``above=False`` turns both thresholds round. Rows without value or clock are left out.
    Windows only: rows between two that clear are a span, rows between two short of the
    trigger a run; a span is active from its first row at which its run is old enough.
    """
    level = F.col(value) if above else -F.col(value)
    trigger, clear = (trigger, clear) if above else (-trigger, -clear)
    counted = lambda c: F.sum(c.cast("int")).over(upto(keys, order))
    df = df.where(F.col(value).isNotNull() & F.col(clock).isNotNull())
    df = df.withColumns({"_span": counted(level < clear), "_run": counted(level < trigger)})
    since = F.min(F.when(level >= trigger, F.col(clock))).over(upto([*keys, "_run"], order))
    df = df.withColumn("_old", ((level >= trigger) & (F.col(clock) - since >= hold)).cast("int"))
    held = F.max("_old").over(upto([*keys, "_span"], order)) == 1
    return df.withColumn("active", held & (level >= clear)).drop("_span", "_run", "_old")


def sustained(df: DataFrame, keys: list[str], order: str, value: str, clock: str, trigger: float, clear: float, hold: float, above: bool = True) -> DataFrame:
    """Rows at which the sustained state begins: (keys, at, value)."""
    rows = sustained_state(df.select(*dict.fromkeys([*keys, order, value, clock])), keys, order, value, clock, trigger, clear, hold, above)
    before = F.coalesce(F.lag("active").over(ordered(keys, order)), F.lit(False))
    return rows.withColumn("_on", F.col("active") & ~before).where("_on").select(*keys, F.col(clock).cast("double").alias("at"), F.col(value).cast("double").alias("value"))


class _Limit(Scan):
    def __init__(self, cooldown: float):
        self.cooldown, self.last, self.level = cooldown, None, None

    def row(self, t, s):
        if t is None or s is None:
            return  # neither passes nor counts
        if self.last is None or t - self.last >= self.cooldown or s > self.level:
            self.last, self.level = t, s
            yield float(t), int(s)


def rate_limited(df: DataFrame, keys: list[str], order: str, clock: str, severity: str, cooldown: float) -> DataFrame:
    """Messages that pass a cooldown since the last one that passed, or are more severe than it: (keys, at, severity)."""
    return scanned(df, keys, order, [clock, severity], "at double, severity int", lambda: _Limit(cooldown))
