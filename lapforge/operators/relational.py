"""The relational catalogue: bests, rollups, listings, merges and set operations on laps and sessions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapforge.sources.scratch import spread, staged


def personal_bests(laps: DataFrame, group: list[str], time: str, lap_id: str, keep: list[str] | None = None) -> DataFrame:
    """The fastest lap of each group (ties to the smaller id) with the group's number of laps.

    Filters on the result belong outside: rank and count see all laps.
    """
    keep = keep or []
    first = F.struct(time, lap_id, *keep)  # combined before the shuffle, so no group is sorted in one task
    best = laps.groupBy(*group).agg(F.min(first).alias("_m"), F.count("*").alias("laps"))
    return best.select(*group, f"_m.{lap_id}", f"_m.{time}", "laps", *[f"_m.{c}" for c in keep])


def gap_to_best(laps: DataFrame, group: list[str], time: str) -> DataFrame:
    """Add ``gap``: time less the least of the group; the small table of bests is joined back, so a group is not gathered."""
    best = laps.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg(F.min(time).alias("_best"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)])
    return laps.join(best, same).withColumn("gap", F.col(time) - F.col("_best")).drop("_best", *[f"_g{i}" for i in range(len(group))])


def top_laps(laps: DataFrame, time: str, lap_id: str, n: int) -> DataFrame:
    """The n fastest; ties newest first."""
    return laps.orderBy(F.col(time), F.col(lap_id).desc()).limit(n)


def session_rollup(sessions: DataFrame, laps: DataFrame, session: str, time: str, counts: Column, category: str) -> DataFrame:
    """Every session with its number of laps, best counting lap and category fallback; sessions without laps stay."""
    agg = laps.groupBy(session).agg(F.count("*").alias("laps"), F.min(F.when(counts, F.col(time))).alias("best"), F.max(category).alias("category"))
    return sessions.join(agg, session, "left").withColumn("laps", F.coalesce("laps", F.lit(0)))


def best_candidate(laps: DataFrame, session: str, lap_id: str, full: Column, size: str, least: int) -> DataFrame:
    """One lap a session to identify it by: full laps first, then the shortest full or longest partial one."""
    order = [full.desc(), F.when(full, F.col(size)).otherwise(-F.col(size)), F.col(lap_id)]
    ranked = laps.where(F.col(size) >= least).withColumn("_r", F.row_number().over(Window.partitionBy(session).orderBy(*order)))
    return ranked.where("_r = 1").drop("_r")


def complete_set_time(laps: DataFrame, session: str, number: str, time: Column) -> DataFrame:
    """Total time of sessions whose lap numbers are exactly 1..n once each, else null."""
    agg = laps.groupBy(session).agg(F.count("*").alias("n"), F.countDistinct(number).alias("_d"), F.min(number).alias("_lo"), F.max(number).alias("_hi"), F.sum(time).alias("_t"))
    whole = (F.col("_d") == F.col("n")) & (F.col("_lo") == 1) & (F.col("_hi") == F.col("n"))
    return agg.select(session, "n", F.when(whole, F.col("_t")).alias("total"))


def union_by_priority(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; of a key that both hold, those of ``first``."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def fuel_projection(laps: DataFrame, session: str, order: list[str], burn: str, time: str, last: int = 3) -> DataFrame:
    """Mean burn and time of the last burning laps, those under half of the largest left out."""
    recent = laps.where(F.col(burn) > 0).withColumn("_r", F.row_number().over(Window.partitionBy(session).orderBy(*[F.col(c).desc() for c in order]))).where(F.col("_r") <= last)
    recent = recent.withColumn("_top", F.max(burn).over(Window.partitionBy(session))).where(F.col(burn) >= 0.5 * F.col("_top"))
    return recent.groupBy(session).agg(F.avg(burn).alias("burn"), F.avg(time).alias("lap_time"), F.count("*").alias("n"))


def fuel_map(df: DataFrame, level: str, burn: str, lap_ms: str) -> DataFrame:
    """Eleven mixture steps from -5 to 5 a row: burn +-10 %, lap time -+250 ms a step; none where an input is not positive."""
    ok = (F.col(level) > 0) & (F.col(burn) > 0) & (F.col(lap_ms) > 0)
    out = df.where(ok).withColumn("step", F.explode(F.sequence(F.lit(-5), F.lit(5))))
    rate = F.col(burn) * (1 + 0.1 * F.col("step"))
    return out.withColumns({"rate": rate, "map_ms": (F.col(lap_ms) - 250 * F.col("step")).cast("long"), "laps_left": F.floor(F.col(level) / rate)})


def resolve_votes(votes: DataFrame, place: list[str], manual: list[str]) -> DataFrame:
    """One kind a place: hand-made kinds beat automatic ones, then the most votes, then the kind's name.

    A source's vote on a kind is its largest count over its runs, so merging evidence again changes nothing.
    """
    per_source = votes.groupBy(*place, "kind", "source").agg(F.max("n").alias("n"))
    kinds = per_source.groupBy(*place, "kind").agg(F.sum("n").alias("votes"))
    order = [F.col("kind").isin(manual).desc(), F.col("votes").desc(), F.col("kind")]
    return kinds.withColumn("_r", F.row_number().over(Window.partitionBy(*place).orderBy(*order))).where("_r = 1").drop("_r")


def event_buckets(events: DataFrame, keys: list[str], at: str, size: float, least: int) -> DataFrame:
    """Counts of events by bucket of distance, those with ``least`` or more."""
    out = events.withColumn("bucket", F.floor(F.col(at) / size).cast("long")).groupBy(*keys, "bucket").agg(F.count("*").alias("hits"))
    return out.where(F.col("hits") >= least)


def _same_signature(length: str, cx: str, cz: str, extents: tuple[str, ...], tolerance: float, reach: float, stretch: float) -> Column:
    off = lambda c: F.abs(F.col(c) - F.col(f"t_{c}"))
    same = (F.col(length) > 0) & (F.col(f"t_{length}") > 0) & (off(length) <= tolerance * F.col(f"t_{length}")) & (off(cx) <= reach) & (off(cz) <= reach)
    for c in extents:
        same = same & ((F.col(f"t_{c}") <= 0) | (off(c) <= stretch * F.col(f"t_{c}")))
    return same


def _octave(length: str, tolerance: float) -> Column:
    """Bucket of a positive length; lengths that agree to ``tolerance`` lie at most one bucket apart."""
    return F.floor(F.ln(F.col(length)) / (-1.001 * math.log(1 - tolerance))).cast("long")


def signature_match(
    laps: DataFrame, tracks: DataFrame, length: str, cx: str, cz: str, extents: tuple[str, ...] = (), tolerance: float = 0.04, reach: float = 120.0, stretch: float = 0.20
) -> DataFrame:
    """Pairs of a lap and a track whose length and extents agree to a share and whose centres lie within reach on both axes.

    A track without an extent (0) is not tested by it; a length of 0 on either side matches nothing. Laps meet the tracks of the cells around
    them, of centre and length, spread over all tasks, so that the work follows the number of pairs.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    near = F.array(*[F.struct((cell(f"t_{cx}") + i).alias("_bx"), (cell(f"t_{cz}") + j).alias("_bz"), (_octave(f"t_{length}", tolerance) + k).alias("_bl")) for i, j, k in steps])
    tracks = tracks.where(F.col(f"t_{length}") > 0)
    wide = tracks.withColumn("_c", F.explode(near)).select(*tracks.columns, "_c.*")
    at = laps.where(F.col(length) > 0).withColumns({"_bx": cell(cx), "_bz": cell(cz), "_bl": _octave(length, tolerance)})
    pairs = spread(at).join(wide, ["_bx", "_bz", "_bl"]).drop("_bx", "_bz", "_bl")
    return pairs.where(_same_signature(length, cx, cz, extents, tolerance, reach, stretch))


def signature_names(laps: DataFrame, tracks: DataFrame, lap: str, name: str, length: str, cx: str, cz: str, tolerance: float = 0.04, reach: float = 120.0) -> DataFrame:
    """(lap, name): the distinct names among the tracks that ``signature_match`` pairs with each lap, without making the pairs.

    Laps and tracks are gathered in cells a quarter as wide as the reach of a match, with the least and largest values in each. Where these show that any lap of
    a cell matches any track of another, its name is settled for the whole cell; only laps and tracks of cells in doubt, for names not
    settled, are compared one by one. The more tracks there are, the fewer are in doubt. Names are held in a struct, so that a null is one too.
    """
    values = (length, cx, cz)
    fine = lambda p: [F.floor(F.col(f"{p}{c}") / (reach / 2)).cast("long").alias(f"{p}f{i}") for i, c in enumerate((cx, cz))] + [F.floor(F.ln(F.col(f"{p}{length}")) / (-math.log(1 - tolerance) / 2)).cast("long").alias(f"{p}f2")]
    ends = lambda p: [f(f"{p}{c}").alias(f"{p}{w}{i}") for i, c in enumerate(values) for f, w in ((F.min, "lo"), (F.max, "hi"))]
    laps = laps.where(F.col(length) > 0).select(lap, *values, *fine(""))
    tracks = tracks.where(F.col(f"t_{length}") > 0).select(F.struct(name).alias("_name"), *[f"t_{c}" for c in values], *fine("t_"))
    own, theirs = ["f0", "f1", "f2"], ["t_f0", "t_f1", "t_f2"]
    here, there = laps.groupBy(*own).agg(*ends("")), tracks.groupBy(*theirs, "_name").agg(*ends("t_"))
    wide = lambda c: F.floor(F.col(c) / 4)
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    blocks = F.explode(F.array(*[F.struct(*[(wide(c) + s).alias(f"w{n}") for n, (c, s) in enumerate(zip(theirs, step))]) for step in steps]))
    met = here.withColumns({f"w{n}": wide(c) for n, c in enumerate(own)}).join(there.withColumn("_w", blocks).select(*there.columns, "_w.*"), ["w0", "w1", "w2"])
    # the farthest and the nearest that a lap and a track of the two cells can lie apart, by axis
    far = [F.greatest(F.col(f"hi{i}") - F.col(f"t_lo{i}"), F.col(f"t_hi{i}") - F.col(f"lo{i}")) for i in (1, 2)]
    close = [F.greatest(F.col(f"lo{i}") - F.col(f"t_hi{i}"), F.col(f"t_lo{i}") - F.col(f"hi{i}")) for i in (1, 2)]
    sure_length = (F.col("hi0") <= (1 + tolerance - 1e-9) * F.col("t_lo0")) & (F.col("lo0") >= (1 - tolerance + 1e-9) * F.col("t_hi0"))
    may_length = (F.col("lo0") <= (1 + tolerance + 1e-9) * F.col("t_hi0")) & (F.col("hi0") >= (1 - tolerance - 1e-9) * F.col("t_lo0"))
    met = met.where((close[0] <= reach) & (close[1] <= reach) & may_length)
    met = met.select(*own, *theirs, "_name", ((far[0] <= reach) & (far[1] <= reach) & sure_length).alias("sure"))
    met = staged(met, "signature-cells")
    sure = met.where("sure").select(*own, "_name").distinct()
    doubt = met.join(sure, [*own, "_name"], "left_anti").select(*own, *theirs, "_name")
    pairs = spread(laps.join(doubt, own)).join(tracks, [*theirs, "_name"]).where(_same_signature(length, cx, cz, (), tolerance, reach, 0.0))
    return laps.join(sure, own).select(lap, f"_name.{name}").unionByName(pairs.select(lap, f"_name.{name}").distinct())


def unambiguous(matches: DataFrame, lap: str, name: str) -> DataFrame:
    """The matched name of each lap; null where distinct names match."""
    agg = matches.groupBy(lap).agg(F.countDistinct(name).alias("candidates"), F.min(name).alias("_n"))
    return agg.select(lap, "candidates", F.when(F.col("candidates") == 1, F.col("_n")).alias(name))


def token_f1(
    left: DataFrame, right: DataFrame, left_id: str, left_tokens: str, right_id: str, right_tokens: str, least: float, length: str | None = None,
    agree: float = 0.04, disagree: float = 0.15, bonus: float = 0.15, penalty: float = 0.4,
) -> DataFrame:
    """The best right row of each left row by the F1 of their token sets: (left_id, right_id, f1, score), ties to the smaller right id.

    With a ``length`` on both sides (positive), agreement within 4 % adds to the score and a
    difference of over 15 % takes from it; a score under ``least`` is no match. Candidates come from an
    equi-join on tokens; rows of equal tokens and length are matched once, so a name that a third
    of all rows bear costs one row.
    """
    size = F.col(length).cast("double") if length else F.lit(None).cast("double")
    a = left.select(left_id, F.array_sort(F.array_distinct(left_tokens)).alias("_a"), size.alias("_la"))
    b = right.select(right_id, F.array_distinct(right_tokens).alias("_b"), size.alias("_lb")).withColumn("_t", F.explode("_b"))
    kinds = a.select("_a", "_la").distinct().withColumn("_t", F.explode("_a"))
    pairs = kinds.join(b.select(right_id, F.size("_b").alias("_nb"), "_lb", "_t"), "_t")
    shared = pairs.groupBy("_a", "_la", right_id, "_nb", "_lb").agg(F.count("*").alias("_k"))
    scored = shared.withColumn("f1", 2 * F.col("_k") / (F.size("_a") + F.col("_nb")))
    apart = F.abs(F.col("_la") - F.col("_lb")) / F.nullif(F.col("_lb"), F.lit(0.0))
    known = (F.col("_la") > 0) & (F.col("_lb") > 0)
    term = F.when(known & (apart <= agree), F.lit(bonus)).when(known & (apart > disagree), F.lit(-penalty)).otherwise(0.0)
    scored = scored.withColumn("score", F.col("f1") + term).where(F.col("score") >= least)
    best = scored.groupBy("_a", "_la").agg(F.max_by(F.struct(right_id, "f1", "score"), F.struct("score", -F.col(right_id))).alias("_m"))
    best = best.select(F.col("_a").alias("_a2"), F.col("_la").alias("_la2"), f"_m.{right_id}", "_m.f1", "_m.score")
    return a.join(best, (F.col("_a") == F.col("_a2")) & F.col("_la").eqNullSafe(F.col("_la2"))).select(left_id, right_id, "f1", "score")
