"""One-to-one pairing of two lists of layouts by length and likeness of names.

Candidates are blocked by circuit and length, and a right row meets no more left rows than it has rivals, so no name meets all others. Left rows choose in order of falling length; in every
round each asks for the most alike candidate that it has left, and each right row asked for is lost to all that come after the first
that asks: the same pairs as going through the left rows one by one.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapforge.sources.scratch import spread, staged

# Greatest difference in length (m); filler words of layout names and what stands for a name of nothing else.
REACH_M, FILLER, WHOLE = 60.0, "layout|course|circuit|full|the", "fullcourse"


def layout_name(name: Column, circuit: Column) -> Column:
    """Comparable form of a layout name: without the words of its circuit (each once), fillers and punctuation; two synonyms made equal."""
    words = F.filter(F.split(F.lower(circuit), "[^a-z0-9]+"), lambda w: w != "")
    cut = lambda n, w: F.when(F.instr(n, w) > 0, F.concat(F.substring(n, F.lit(1), F.instr(n, w) - 1), F.lit(" "), F.substring(n, F.instr(n, w) + F.length(w), F.length(n)))).otherwise(n)
    n = F.aggregate(words, F.lower(name), cut)
    n = F.replace(F.replace(n, F.lit("grand prix"), F.lit(" gp ")), F.lit("shortcut"), F.lit(" short "))
    n = F.regexp_replace(F.regexp_replace(n, rf"\b({FILLER})\b|[^a-z0-9]", " "), r"\s+", "")
    return F.coalesce(F.nullif(n, F.lit("")), F.lit(WHOLE))


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts, in [0, 1]."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def candidates(left: DataFrame, right: DataFrame, reach: float = REACH_M) -> DataFrame:
    """(circuit, a, b, length, score) of rows (circuit, id, name, length) of one circuit whose lengths differ by at most ``reach`` and that may be paired.

    As long as a right row is free, each left row in reach of it takes some right row, none of which lies over twice the reach away. So it is
    taken by one of as many left rows in order as there are such right rows; all others cannot get it, and their names are not compared.
    """
    bucket = lambda c, size=reach: F.floor(c / size).cast("long")
    around = lambda c: F.explode(F.array(*[c + i for i in (-1, 0, 1)]))
    wide = bucket(F.col("length"), 2.001 * reach)  # a little over twice the reach, so that no rounding leaves one out
    rivals = right.groupBy("circuit", wide.alias("wide")).agg(F.count("*").alias("n")).select("circuit", "n", around(F.col("wide")).alias("wide"))
    rivals = rivals.groupBy("circuit", "wide").agg(F.sum("n").alias("n"))
    b = right.withColumn("wide", wide).join(rivals, ["circuit", "wide"]).select("circuit", F.col("id").alias("b"), F.col("length").alias("b_length"), "n", bucket(F.col("length")).alias("at"))
    a = spread(left.select("circuit", "id", "length")).select("circuit", F.col("id").alias("a"), "length", around(bucket(F.col("length"))).alias("at"))
    pairs = a.join(b, ["circuit", "at"]).where(F.abs(F.col("length") - F.col("b_length")) <= reach)
    turn = F.dense_rank().over(Window.partitionBy("circuit", "b").orderBy(F.col("length").desc(), "a"))
    pairs = pairs.withColumn("turn", turn).where("turn <= n").select("circuit", "a", "b", "length")
    pairs = pairs.join(left.select("circuit", F.col("id").alias("a"), F.col("name").alias("a_name")), ["circuit", "a"])
    pairs = pairs.join(right.select("circuit", F.col("id").alias("b"), F.col("name").alias("b_name")), ["circuit", "b"])
    pairs = spread(pairs, "circuit", "b")
    score = likeness(layout_name(F.col("a_name"), F.col("circuit")), layout_name(F.col("b_name"), F.lit("")))
    return pairs.select("circuit", "a", "b", "length", score.alias("score"))


def paired(left: DataFrame, right: DataFrame, reach: float = REACH_M) -> DataFrame:
    """(circuit, a, b, score): each left row's pair; ties of length go to the smaller id, ties of likeness to the smaller id on the right."""
    open_ = staged(candidates(left, right, reach), "candidates")
    turn = F.struct((-F.col("length")).alias("l"), "a")
    while True:
        asks = open_.groupBy("circuit", "a").agg(F.min(F.struct((-F.col("score")).alias("s"), "b", "length")).alias("m")).select("circuit", "a", F.col("m.b").alias("b"), F.col("m.length").alias("length"), (-F.col("m.s")).alias("score"))
        # whoever gets b in the end does not come after the first that asks for it now
        held = asks.groupBy("circuit", "b").agg(F.min(turn).alias("first"))
        kept = staged(open_.join(held, ["circuit", "b"], "left").where(F.col("first").isNull() | (turn <= F.col("first"))).drop("first"), "candidates")
        if kept.count() == open_.count():
            return asks.select("circuit", "a", "b", "score")
        open_ = kept


def reverse_partners(layouts: DataFrame, reach: float = REACH_M) -> DataFrame:
    """(circuit, id, partner) of forward rows (circuit, id, length, reverse): the reverse row of the circuit closest in length, within ``reach``; ties to the smaller id."""
    bucket = lambda c: F.floor(c / reach).cast("long")
    a = layouts.where("not reverse").select("circuit", "id", "length", F.explode(F.array(*[bucket(F.col("length")) + i for i in (-1, 0, 1)])).alias("at"))
    b = layouts.where("reverse").select("circuit", F.col("id").alias("partner"), F.col("length").alias("l"), bucket(F.col("length")).alias("at"))
    off = F.abs(F.col("length") - F.col("l"))
    return a.join(b, ["circuit", "at"]).where(off <= reach).groupBy("circuit", "id").agg(F.min(F.struct(off.alias("off"), "partner"))["partner"].alias("partner"))
