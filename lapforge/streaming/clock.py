"""Structured Streaming: the packet clock, a throttle, and sustained thresholds with state.

State is kept per key in applyInPandasWithState, so a stream run with availableNow gives the
rows of the batch operators. Rows of a micro-batch are put in order of their counter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 1 / 60


def packet_clock(stream: DataFrame, key: str, counter: str, largest: int = 60) -> DataFrame:
    """(key, counter, frames): frames since the key's start, gaps of 1 to ``largest`` counted, others as one."""

    def step(k, frames_: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, total = state.get if state.exists else (None, 0)
        out = []
        for c in sorted(x for f in frames_ for x in f[counter]):
            gap = 1 if last is None or not 1 <= c - last <= largest else c - last
            total += gap
            last = c
            out.append((k[0], c, total))
        state.update((last, total))
        yield pd.DataFrame(out, columns=[key, counter, "frames"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, F.col(counter).cast("long")).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {counter} long, frames long", "last long, total long", "append", "NoTimeout")


def sustained(stream: DataFrame, key: str, clock: str, value: str, trigger: float, clear: float, hold: float) -> DataFrame:
    """(key, at, value): rows at which a value has held ``trigger`` for ``hold``; state crosses micro-batches."""

    def step(k, frames_: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        since, active = state.get if state.exists else (float("nan"), False)
        out = []
        for f in frames_:
            for t, v in f.sort_values(clock)[[clock, value]].dropna().itertuples(index=False):
                since = (t if since != since else since) if v >= trigger else float("nan")
                was, active = active, v >= clear if active else t - since >= hold
                if active and not was:
                    out.append((k[0], float(t), float(v)))
        state.update((float(since), bool(active)))
        yield pd.DataFrame(out, columns=[key, "at", "value"])

    kind = stream.schema[key].dataType.simpleString()
    columns = stream.select(key, F.col(clock).cast("double").alias(clock), F.col(value).cast("double").alias(value))
    return columns.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at double, value double", "since double, active boolean", "append", "NoTimeout")


def latest_per_window(stream: DataFrame, key: str, ts: str, every: str, late: str, columns: list[str]) -> DataFrame:
    """The last row of each key and window: a rate limit that keeps the newest frame."""
    w = stream.withWatermark(ts, late).groupBy(key, F.window(ts, every))
    return w.agg(F.max(F.struct(ts, *columns)).alias("_m")).select(key, F.col("window.start").alias("start"), "_m.*")
