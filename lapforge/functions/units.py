"""Units, signed times, list specs, digests and gear tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors of the display and of the voice.
MPH_SHOWN, KM_A_MILE, METRES_A_FOOT = 0.621371, 1.609344, 0.3048


def delta_text(ms: Column) -> Column:
    """Signed seconds with three digits: a plus from 0 on, else the minus sign U+2212."""
    ms = ms.cast("long")
    whole = F.concat(F.floor(F.abs(ms) / 1000).cast("string"), F.lit("."), F.lpad((F.abs(ms) % 1000).cast("string"), 3, "0"))
    return F.concat(F.when(ms >= 0, "+").otherwise("−"), whole)


def duration_text(ms: Column) -> Column:
    """Hours and minutes, or minutes and seconds under an hour; an en dash for null or negative."""
    part = lambda c: F.floor(c).cast("long").cast("string")
    long = F.concat(part(ms / 3_600_000), F.lit("h "), part(ms % 3_600_000 / 60_000), F.lit("m"))
    short = F.concat(part(ms % 3_600_000 / 60_000), F.lit("m "), part(ms % 60_000 / 1000), F.lit("s"))
    return F.when(ms.isNull() | (ms < 0), "–").when(ms >= 3_600_000, long).otherwise(short)


def shown_speed(kmh: Column, imperial: bool) -> Column:
    return kmh * MPH_SHOWN if imperial else kmh


def spoken_speed(kmh: Column, imperial: bool) -> Column:
    return kmh / KM_A_MILE if imperial else kmh


def spoken_distance(metres: Column, imperial: bool) -> Column:
    return metres / METRES_A_FOOT if imperial else metres


def list_spec(spec: Column, known: list[str]) -> Column:
    """Known names of a comma list, trimmed, each once in order of its first mention."""
    names = F.transform(F.split(spec, ","), lambda n: F.trim(n))
    return F.array_distinct(F.filter(names, lambda n: n.isin(known)))


def digest(text: Column, length: int = 64) -> Column:
    """The first hex digits of the SHA-256 of a text's UTF-8 bytes."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def gear_speeds(ratios: Column, top_speed: Column) -> Column:
    """Array of (gear from 1, ratio, speed at the rev limit): the top speed belongs to the last ratio."""
    last = F.element_at(ratios, -1)
    return F.transform(ratios, lambda r, i: F.struct((i + 1).alias("gear"), r.alias("ratio"), (top_speed * last / r).alias("speed")))
