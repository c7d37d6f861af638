"""Structured Streaming: laps of a packet stream with salvage, by transformWithState.

A key's state is one row of counters and the list of buffered ticks, to which a micro-batch appends; the list is read only when a lap
may have ended. Run with availableNow, the stream gives the rows of ``operators.salvage.lap_stream``. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lapforge.operators.lifecycle import CLOCK_JUMP
from lapforge.operators.salvage import COLUMNS, FRAME_GAP, LAP0_TICKS, MIN_TICKS, TOLERANCE_MS, TOLERANCE_SHARE

OUT = "session long, lap long, time_ms long, ticks long, trimmed long, length_m double, fuel_start double, fuel_end double, salvaged boolean"
SCALARS = "session long, open boolean, car long, lap long, last_id long, p_last long, p_best long, p_fuel double, first_fuel double, frames long, meters double, n long"
TICK = "frames long, meters double, clock long, fuel double"


def stretches(clock: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches of a lap clock between backward jumps, without frozen head and tail, the latest first."""
    cuts = [0, *[i for i in range(1, len(clock)) if clock[i] + CLOCK_JUMP < clock[i - 1]], len(clock)]
    for low, high in reversed(list(zip(cuts, cuts[1:]))):
        rising = [i for i in range(low + 1, high) if clock[i] > clock[i - 1]]
        yield (rising[0] - 1, rising[-1] + 1) if rising else (high - 1, high)


class Laps(StatefulProcessor):
    def __init__(self, key: str, order: str, min_ticks: int, lap0_ticks: int):
        self.key, self.order, self.min_ticks, self.lap0_ticks = key, order, min_ticks, lap0_ticks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scalars, self.ticks = handle.getValueState("scalars", SCALARS), handle.getListState("ticks", TICK)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCALARS.split(", ")]
        s = dict(zip(names, self.scalars.get())) if self.scalars.exists() else dict.fromkeys(names) | {"session": 0, "open": False, "lap": -1, "frames": 0, "meters": 0.0, "n": 0}
        batch = pd.concat(list(rows)).sort_values(self.order)
        out, fresh, stored = [], [], True  # ticks of this batch; whether those in the state still count

        def empty(fuel) -> None:
            nonlocal stored
            fresh.clear()
            stored = False
            s.update(frames=0, meters=0.0, n=0, first_fuel=fuel)

        def salvaged(at, last, best) -> tuple | None:
            reported = [c for c in (last, best, s["p_last"], s["p_best"]) if c is not None and c > 0]
            if s["n"] < self.min_ticks or not reported:
                return None
            held = [*(self.ticks.get() if stored else ()), *fresh]
            clock = [t[2] for t in held]
            for low, high in stretches(clock) if None not in clock and not any(c != c for c in clock) else [(0, len(held))]:
                tenths = [round(held[i][0] * 10000 / 60) for i in (low, high - 1)]
                took = round((tenths[1] - tenths[0]) / 10)
                hit = next((c for c in reported if abs(c - took) <= max(TOLERANCE_MS, took * TOLERANCE_SHARE)), None)
                if high - low >= self.min_ticks and hit is not None:
                    whole = high - low == len(held)
                    length = round(held[-1][1], 2) if whole else round(round(held[high - 1][1], 2) - round(held[low][1], 2), 2)
                    return at, s["session"], s["lap"], hit, high - low, len(held) - (high - low), length, held[low][3], s["p_fuel"], True
            return None

        for at, pid, car, lap, total, on_track, paused, loading, last, best, clock, speed, fuel in batch[[self.order, *COLUMNS]].itertuples(index=False):
            if loading:
                if s["open"] and (made := salvaged(at, last, best)):
                    out.append(made)
                    empty(fuel)
                    s["open"] = False
                continue
            gap = 1 if s["last_id"] is None else pid - s["last_id"]
            frames = gap if 1 <= gap <= FRAME_GAP else 1
            torn = s["open"] and (car != s["car"] or 0 <= lap < s["lap"])
            if torn and (made := salvaged(at, last, best)):
                out.append(made)
            if torn or not s["open"]:
                s.update(session=s["session"] + 1, open=True, car=car, lap=-1)
                empty(fuel)
            if lap != s["lap"]:
                if s["lap"] > 0 and lap == s["lap"] + 1 and last > 0 and s["n"] >= self.min_ticks:
                    out.append((at, s["session"], s["lap"], last, s["n"], 0, round(s["meters"], 2), s["first_fuel"], fuel, False))
                elif made := salvaged(at, last, best):
                    out.append(made)
                    s["open"] = False
                empty(fuel)
                s["lap"] = lap
            if on_track and not paused and lap >= 0 and not 0 < total < lap:
                if lap == 0 and s["n"] >= self.lap0_ticks:
                    empty(fuel)
                s["frames"] += frames if s["n"] else 0
                s["meters"] += speed * frames / 60
                s["n"] += 1
                fresh.append((int(s["frames"]), float(s["meters"]), None if clock is None or clock != clock else int(clock), float(fuel)))
            s.update(last_id=pid, p_last=last, p_best=best, p_fuel=fuel)
        if not stored:
            self.ticks.clear()
        if fresh:
            self.ticks.appendList(fresh)
        kinds = {"long": int, "boolean": bool, "double": float}
        self.scalars.update(tuple(None if s[n] is None else kinds[kind](s[n]) for n, kind in (f.split() for f in SCALARS.split(", "))))
        yield pd.DataFrame([(key[0], *row) for row in out], columns=[self.key, self.order, *[f.split()[0] for f in OUT.split(", ")]])


def lap_stream(stream: DataFrame, key: str, order: str, min_ticks: int = MIN_TICKS, lap0_ticks: int = LAP0_TICKS) -> DataFrame:
    """(key, order, session, lap, ...): a row a lap, at the packet that ended it; packets of a key come in order, within a micro-batch they are sorted."""
    kind = lambda c: stream.schema[c].dataType.simpleString()
    whole = [F.col(c).cast("long").alias(c) for c in ("packet_id", "car_id", "current_lap", "total_laps", "clock_ms")]
    whole += [F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in ("last_ms", "best_ms")]
    rows = stream.select(key, order, *whole, "on_track", "paused", "loading", *[F.col(c).cast("double").alias(c) for c in ("speed", "fuel")])
    schema = f"{key} {kind(key)}, {order} {kind(order)}, {OUT}"
    return rows.groupBy(key).transformWithStateInPandas(Laps(key, order, min_ticks, lap0_ticks), schema, "Append", "None")
