"""Surveyed borders put in order: cells linked into chains, chains stitched, loops closed, coverage measured.

A border is a cloud of cells (x, z in metres) with a heading each, whose sign may point either way, as runs were
driven in both. ``keys`` name a border (circuit and side, say); any number of borders is ordered at
once. A border (thousands of cells) is shuffled once and linked in one task; a very large one is linked by joins with a grid cell as their
key. Places come from pointer jumping either way, so no border is walked cell by cell. What follows on ordered chains uses windows over one chain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lapforge.sources.scratch import spread, staged

from . import chaining, paths
from .spatial import around, cell

# Longest step of a chain (m), least forward and tangent products, least cells of a chain.
STEP_M, FORWARD, TANGENT, LEAST_CELLS = 5.0, 0.35, 0.5, 5
# Borders with more pairs of cells than this in one place (squares of cells 5 m wide, summed) are ordered by joins, not in one task.
WHOLE_PAIRS = 1_000_000
# Longest join of chains (m), and for joins above so many metres the least agreement of the ends.
JOIN_M = 40.0
JOIN_GATES = ((25.0, 0.75), (8.0, 0.6), (0.0, 0.2))
# Longest span that counts as surveyed (m); least cells and agreement of a loop's ends; cells over which an end's direction is taken.
SURVEYED_M, LOOP_CELLS, LOOP_AGREEMENT, END_CELLS = 6.0, 20, 0.2, 6


def _hypot(x: Column, z: Column) -> Column:
    return F.sqrt(x * x + z * z)


def _pairs(df: DataFrame, keys: list[str], size: float, carry: list[str]) -> DataFrame:
    """Pairs of rows of one key within ``size`` metres in x or z, each once (id of a below that of b), with the carried columns as a_ and b_."""
    a = around(df, "x", "z", size).select(*keys, "cx", "cz", *[F.col(c).alias(f"a_{c}") for c in carry])
    b = df.select(*[F.col(k).alias(f"r_{k}") for k in keys], cell("x", size).alias("r_cx"), cell("z", size).alias("r_cz"), *[F.col(c).alias(f"b_{c}") for c in carry])
    on = paths._on(keys, {"cx": "r_cx", "cz": "r_cz"}) & (F.col("a_id") < F.col("b_id"))
    return a.join(b, on).select(*keys, *[f"{p}_{c}" for c in carry for p in "ab"])


def cell_links(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Links (keys, a, s, b, t, score) between neighbouring cells of a border, at most one ahead (+1) and one behind (-1) of each.

    Two cells may be linked over at most 5 m if each lies ahead of the other's heading line (either way) and the headings are near parallel;
    pairs are taken in order of distance over forwardness. A cell without a heading, or in the place of another, is not linked.
    """
    p = _pairs(cells, keys, STEP_M, ["id", "x", "z", "hx", "hz"])
    d = _hypot(F.col("b_x") - F.col("a_x"), F.col("b_z") - F.col("a_z"))
    p = p.withColumn("d", d).where((F.col("d") > 0) & (F.col("d") <= STEP_M))
    along = lambda side: ((F.col("b_x") - F.col("a_x")) * F.col(f"{side}_hx") + (F.col("b_z") - F.col("a_z")) * F.col(f"{side}_hz")) / F.col("d")
    p = p.withColumns({"fa": along("a"), "fb": -along("b"), "tangent": F.abs(F.col("a_hx") * F.col("b_hx") + F.col("a_hz") * F.col("b_hz"))})
    forward = F.least(F.abs("fa"), F.abs("fb"))
    p = p.where((forward >= FORWARD) & (F.col("tangent") >= TANGENT))
    port = lambda c: F.when(F.col(c) > 0, 1).otherwise(-1)
    pairs = p.select(*keys, F.col("a_id").alias("a"), port("fa").alias("s"), F.col("b_id").alias("b"), port("fb").alias("t"), (F.col("d") / forward).alias("score"))
    return paths.matched(pairs, keys, ["score"])


def chains(cells: DataFrame, keys: list[str], least: int = LEAST_CELLS, whole: int = WHOLE_PAIRS) -> DataFrame:
    """(cells' columns, chain, place, size): the cells of chains of at least ``least`` cells, in order within their chain.

    ``cells`` has keys, id (unique in a border), x, z, hx, hz. A chain is named by its first cell by (x, z, id), whose heading
    points ahead in it; a ring begins at that cell. A border is shuffled once and put in order in one task, unless it has so many cells close
    together (``whole``: most pairs of cells in one place, summed over a border) that it is ordered by joins instead.
    """
    near = cells.groupBy(*keys, cell("x", STEP_M).alias("cx"), cell("z", STEP_M).alias("cz")).agg(F.count("*").alias("n"))
    many = near.groupBy(*keys).agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).where(F.col("pairs") > whole)
    many = staged(many.select(*keys), "large-borders")
    if many.isEmpty():
        return staged(_chains_whole(cells, keys, least), "chains")
    of = F.broadcast(paths._right(many, keys))
    small, large = (cells.join(of, paths._on(keys, {}), how) for how in ("left_anti", "left_semi"))
    return staged(_chains_whole(small, keys, least).unionByName(_chains_joined(large, keys, least)), "chains")


def _chains_whole(cells: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The chains of borders of which each fits in a task."""

    def order(border: pa.Table) -> pa.Table:
        border = border.take(pc.sort_indices(border.column("id")))
        ids, (x, z, hx, hz) = border.column("id"), (border.column(c).cast(pa.float64()).to_numpy() for c in ("x", "z", "hx", "hz"))
        known = [border.column(c).is_valid().to_numpy() for c in "xz"]
        seed = np.empty(len(x), np.int64)
        seed[np.lexsort((z, known[1], x, known[0]))] = np.arange(len(x))
        path, place, size = chaining.ranked(seed, *chaining.links(x, z, hx, hz, STEP_M, FORWARD, TANGENT))
        out = border.append_column("chain", ids.take(pa.array(path))).append_column("place", pa.array(place)).append_column("size", pa.array(size))
        return out.filter(pa.array(size >= least))

    schema = StructType([*cells.schema.fields, StructField("chain", cells.schema["id"].dataType), StructField("place", LongType()), StructField("size", LongType())])
    return spread(cells, *keys).groupBy(*keys).applyInArrow(order, schema)


def _chains_joined(cells: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The same by joins alone: no border is ever gathered in a task."""
    nodes = cells.select(*keys, "id", F.struct("x", "z", "id").alias("seed"))
    links = cell_links(cells, keys)
    lines, rings = paths.ranked(nodes, links, keys)
    placed = lines.unionByName(rings).where(F.col("size") >= least)
    right = paths._right(placed, keys, i="id", chain="path", place="place", size="size")
    return cells.join(right, paths._on(keys, {"id": "i"})).select(*cells.columns, "chain", "place", "size")


def _direction(end: str, back: str) -> tuple[Column, Column]:
    x, z = F.col(f"{end}.x") - F.col(f"{back}.x"), F.col(f"{end}.z") - F.col(f"{back}.z")
    n = F.greatest(_hypot(x, z), F.lit(1e-300))
    return x / n, z / n


def _ends(ordered: DataFrame, keys: list[str], chain: str) -> DataFrame:
    """(keys, chain, size, x, z, dx, dz of head and tail): the ends of chains and the directions that point out of them."""
    back = F.least(F.lit(END_CELLS), F.col("size") - 1)
    at = lambda place: F.max(F.when(F.col("place") == place, F.struct("x", "z")))
    ends = ordered.groupBy(*keys, chain, "size").agg(at(F.lit(0)).alias("h0"), at(back).alias("h1"), at(F.col("size") - 1).alias("t0"), at(F.col("size") - 1 - back).alias("t1"))
    out = [*keys, chain, "size"]
    for e, name in (("h", "head"), ("t", "tail")):
        dx, dz = _direction(f"{e}0", f"{e}1")
        out.append(F.struct(F.col(f"{e}0.x").alias("x"), F.col(f"{e}0.z").alias("z"), dx.alias("dx"), dz.alias("dz")).alias(name))
    return ends.select(*out)


def stitched(ordered: DataFrame, keys: list[str]) -> DataFrame:
    """(cells' columns, line, place, size): chains joined end to end where their ends face each other.

    Ends within 40 m of different lines may be joined if their directions agree (the more, the longer the join) and neither lies behind the
    other. In every round, ends that are each other's nearest are joined (ties: smaller chain), but not the longest of joins that would close a ring; rounds go on until none is left.
    A line is named by its longest chain (ties: smaller name), which gives it its direction.
    """
    each = staged(_ends(ordered, keys, "chain"), "chain-ends")
    port = lambda e, s: each.select(*keys, F.col("chain").alias("c"), F.lit(s).alias("port"), f"{e}.*")
    ends = port("head", -1).unionByName(port("tail", 1))
    # the name of an end, so that a pair is seen once: chains are numbers
    ends = staged(ends.withColumn("id", F.struct("c", "port")), "line-ends")
    p = _pairs(ends, keys, JOIN_M, ["id", "x", "z", "dx", "dz"]).where("a_id.c <> b_id.c")
    x, z = F.col("b_x") - F.col("a_x"), F.col("b_z") - F.col("a_z")
    p = p.withColumn("d", _hypot(x, z)).where(F.col("d") <= JOIN_M)
    need = F.when(F.col("d") > JOIN_GATES[0][0], JOIN_GATES[0][1]).when(F.col("d") > JOIN_GATES[1][0], JOIN_GATES[1][1]).otherwise(JOIN_GATES[2][1])
    agree = -(F.col("a_dx") * F.col("b_dx") + F.col("a_dz") * F.col("b_dz"))
    ahead = (F.col("d") <= 0.5) | ((x * F.col("a_dx") + z * F.col("a_dz") >= 0) & (-x * F.col("b_dx") - z * F.col("b_dz") >= 0))
    p = p.where((agree >= need) & ahead)
    pairs = staged(p.select(*keys, F.col("a_id.c").alias("a"), F.col("a_id.port").alias("s"), F.col("b_id.c").alias("b"), F.col("b_id.port").alias("t"), "d"), "end-pairs")
    nodes = each.select(*keys, F.col("chain").alias("id"), F.struct((-F.col("size")).alias("n"), F.col("chain").alias("id")).alias("seed"))
    links, placed = pairs.limit(0), None
    rank = F.struct("d", "a", "b", "s", "t")
    while True:
        sides = pairs.select(*keys, F.col("a").alias("i"), F.col("s").alias("p"), rank.alias("rank")).unionByName(pairs.select(*keys, F.col("b").alias("i"), F.col("t").alias("p"), rank.alias("rank")))
        first = sides.groupBy(*keys, "i", "p").agg(F.min("rank").alias("rank"))
        both = staged(first.groupBy(*keys, "rank").count().where("count = 2").select(*keys, "rank.*"), "joins")
        if both.isEmpty():
            break
        links = links.unionByName(both.select(*links.columns))
        placed, rings = paths.ranked(nodes, links, keys)
        if not rings.isEmpty():
            links = staged(paths.cut_rings(links, rings, keys, ["d"]), "joins")
            placed, _ = paths.ranked(nodes, links, keys)
        placed = staged(placed, "lines")
        # ends in use, and pairs within one line, are out
        used = paths._right(paths.both_ways(links, keys), keys, i="a", p="s")
        line = lambda name: paths._right(placed, keys, **{name: "id", f"{name}_line": "path"})
        left = pairs.join(used, paths._on(keys, {"a": "i", "s": "p"}), "left_anti")
        left = left.join(used, paths._on(keys, {"b": "i", "t": "p"}), "left_anti")
        of_a, of_b = line("la"), line("lb")
        left = left.join(of_a, paths._on(keys, {"a": "la"})).select(*pairs.columns, "la_line")
        left = left.join(of_b, paths._on(keys, {"b": "lb"})).where("la_line <> lb_line").select(*pairs.columns)
        pairs = staged(left, "end-pairs")
    if placed is None:
        return spread(ordered.withColumnRenamed("chain", "line"), *keys, rows=ordered.count())
    sized = placed.drop("size")
    size = paths._right(each, keys, c="chain", cells="size")
    sized = sized.join(size, paths._on(keys, {"id": "c"})).select(*keys, "id", "path", "place", "ahead", "cells")
    w = Window.partitionBy(*keys, "path")
    sized = sized.withColumns({"before": F.coalesce(F.sum("cells").over(w.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "whole": F.sum("cells").over(w)})
    # the row of a chain reaches its cells in a sort of their border: this one shuffle serves all that follows along lines
    of = sized.select(*keys, F.col("id").alias("chain"), F.struct(F.col("path").alias("line"), "before", "whole", "ahead").alias("_of"))
    out = spread(ordered.unionByName(of, allowMissingColumns=True), *keys, rows=ordered.count())
    out = out.withColumn("_of", F.max("_of").over(Window.partitionBy(*keys, "chain"))).where("place is not null")
    place = F.col("_of.before") + F.when(F.col("_of.ahead"), F.col("place")).otherwise(F.col("size") - 1 - F.col("place"))
    kept = [c for c in ordered.columns if c not in ("chain", "place", "size")]
    return out.select(*kept, "_of.line", place.alias("place"), F.col("_of.whole").alias("size"))


def steps(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of stitched lines: keys, line, place, size, main, the cell and the next (p, q: structs of id, x, z, y), d, gap, seam.

    One row for each step along a line, and one that closes the main line if it is a loop (the longest line of a border; its ends lie
    within 40 m, agree, and it has 20 cells or more). Spans above 6 m are gaps. Cells that ``stitched`` has brought together are not shuffled again.
    """
    if "y" not in lines.columns:
        lines = lines.withColumn("y", F.lit(None).cast("double"))
    line = Window.partitionBy(*keys, "line")
    along = line.orderBy("place")
    c = lines.select(*keys, "line", "place", "size", F.struct("id", "x", "z", "y").alias("p"))
    c = c.withColumns({"q": F.lead("p").over(along), "h0": F.first("p").over(along)})
    d = _hypot(F.col("q.x") - F.col("p.x"), F.col("q.z") - F.col("p.z"))
    back = F.least(F.lit(END_CELLS), F.col("size") - 1)
    at = lambda place: F.max(F.when(F.col("place") == place, F.struct("p.x", "p.z"))).over(line)
    c = c.withColumns({"length": F.sum(d).over(line), "h1": at(back), "t0": at(F.col("size") - 1), "t1": at(F.col("size") - 1 - back)})
    longest = F.min(F.when(F.col("length").isNotNull(), F.struct(-F.col("length"), "line"))).over(Window.partitionBy(*keys))
    (hx, hz), (tx, tz) = _direction("h0", "h1"), _direction("t0", "t1")
    closed = (_hypot(F.col("h0.x") - F.col("t0.x"), F.col("h0.z") - F.col("t0.z")) <= JOIN_M) & (F.col("size") >= LOOP_CELLS) & (-(hx * tx + hz * tz) >= LOOP_AGREEMENT)
    c = c.withColumn("main", F.col("line") == longest["line"]).withColumn("seam", F.coalesce(F.col("q").isNull() & F.col("main") & closed, F.lit(False)))
    c = c.withColumn("q", F.when(F.col("seam"), F.col("h0")).otherwise(F.col("q"))).where("q is not null").withColumn("d", d)
    return c.select(*keys, "line", "place", "size", "p", "q", "d", "main", "seam", (F.col("d") > SURVEYED_M).alias("gap"))


def assembled(lines: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(spans, borders) of stitched lines: the spans of ``steps``, stored, and for each border keys, lines, closed, surveyed_m, gap_m, pct."""
    spans = staged(steps(lines, keys), "spans")
    meters = lambda gap: F.coalesce(F.sum(F.when(F.col("gap") == gap, F.col("d"))), F.lit(0.0))
    cover = spans.groupBy(*keys).agg(F.countDistinct("line").alias("lines"), F.bool_or("seam").alias("closed"), meters(False).alias("s"), meters(True).alias("g"))
    pct = F.when(F.col("s") + F.col("g") > 0, F.round(100 * F.col("s") / (F.col("s") + F.col("g")), 1)).otherwise(0.0)
    return spans, cover.select(*keys, "lines", "closed", F.round("s", 1).alias("surveyed_m"), F.round("g", 1).alias("gap_m"), pct.alias("pct"))


def order_borders(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Chains and stitches in one: (cells' columns, line, place, size)."""
    return stitched(chains(cells, keys), keys)
