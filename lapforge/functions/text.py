"""Text functions as column expressions: times, slugs, tokens, guarded cells, spoken numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def lap_time(ms: Column) -> Column:
    """m:ss.mmm of whole milliseconds."""
    ms = ms.cast("long")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat(F.floor(ms / 60000).cast("string"), F.lit(":"), pad(F.floor(ms / 1000) % 60, 2), F.lit("."), pad(ms % 1000, 3))


def clock(ms: Column) -> Column:
    """HH:MM of milliseconds, modulo a day."""
    minute = F.floor(F.pmod(ms.cast("long"), F.lit(86_400_000)) / 60000)
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(pad(F.floor(minute / 60)), F.lit(":"), pad(minute % 60))


def slug(name: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one dash, trimmed; 'unnamed' if nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("unnamed"))


def tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: t != "")


def csv_guard(value: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a leading quote."""
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def spoken_int(n: Column) -> Column:
    """Words of -9999 to 9999; other numbers as digits."""
    small, tens = F.array(*map(F.lit, SMALL)), F.array(*map(F.lit, TENS))

    def below_hundred(c: Column) -> Column:
        unit = F.when(c % 10 > 0, F.concat(F.lit("-"), F.get(small, (c % 10).cast("int")))).otherwise(F.lit(""))
        return F.when(c < 20, F.get(small, c.cast("int"))).otherwise(F.concat(F.get(tens, (F.floor(c / 10) - 2).cast("int")), unit))

    def below_thousand(c: Column) -> Column:
        rest = F.when(c % 100 > 0, F.concat(F.lit(" "), below_hundred(c % 100))).otherwise(F.lit(""))
        return F.when(c < 100, below_hundred(c)).otherwise(F.concat(F.get(small, F.floor(c / 100).cast("int")), F.lit(" hundred"), rest))

    whole, n = n.cast("long"), F.abs(n.cast("long"))
    rest = F.when(n % 1000 > 0, F.concat(F.lit(" "), below_thousand(n % 1000))).otherwise(F.lit(""))
    words = F.when(n < 1000, below_thousand(n)).otherwise(F.concat(F.get(small, F.floor(n / 1000).cast("int")), F.lit(" thousand"), rest))
    return F.when(n <= 9999, F.concat(F.when(whole < 0, F.lit("minus ")).otherwise(F.lit("")), words)).otherwise(whole.cast("string"))


def clean_tags(tags: Column) -> Column:
    """Trimmed, without commas and empties, at most 40 characters; the first of equal ones in any case."""
    trimmed = F.filter(F.transform(tags, lambda t: F.substring(F.trim(F.replace(t, F.lit(","), F.lit(" "))), 1, 40)), lambda t: t != "")
    return F.aggregate(
        trimmed, F.array().cast("array<string>"), lambda kept, t: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(t)), kept).otherwise(F.concat(kept, F.array(t)))
    )
