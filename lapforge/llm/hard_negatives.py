"""Hard negatives of anchor vectors by an inverted multi-index with exact stopping.

Vectors are scaled and floored to whole numbers; a score is an inner product, so all
comparisons are exact. An anchor's positives are its nearest rows of the same label; for each of
them the nearest rows of other labels are wanted whose scores lie in a window of percentages of the
positive's score.

Index: two codebooks, one for each half of the components, fitted on a bounded sample
(``SAMPLE`` vectors) with one code for every ``CELL_ROWS`` rows squared; every row is
indexed by the pair of its codes (its cell) and lies in a shard of about
``SHARD_ROWS`` rows. A half's bound for a code is the half score of its centre plus the norm of the half times the
radius of the code; no row of a cell scores more than the sum of its two bounds. A heap over the two sorted
lists of bounds (multi-sequence) visits cells from the highest sum down.

Search goes in rounds, each of which visits cells of ``GROWTH`` times as many rows. An anchor
stops as soon as its result is certain: for positives, when the next bound is below the last of them; for
negatives, when every window is full with scores above the next bound, or lies above it. Cells whose
rows all score above every window are passed over. So nothing is approximate: where bounds are loose, more cells
are visited, at worst all of them, each once for positives and once for negatives.

Scale: an anchor meets a shard once a round, with the list of cells to visit there; shards and the anchors of a
shard are cut into parts of bounded rows, each part pair returns its few best. What the driver sees is the sample,
one radius a code and one count a cell (at most ``MAX_CODES`` squared). As vectors of high dimension have loose
bounds, work may grow as anchors times rows.

Edge cases: rows with a null id, label, vector or component, with a non-finite component, of another length than
most, or with a squared norm of 2**62 or more after scaling take no part; rows that repeat an id are one row (the first by
label and vector); ties go to the smaller id; a negative positive score has an empty window; an empty table gives an
empty result; other columns of the input play no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, staged

SAMPLE = 16_384
MAX_CODES = 256
CELL_ROWS = 128
SHARD_ROWS = 8192
ANCHOR_ROWS = 2048
FIRST_ROWS, GROWTH = 4096, 8
NONE = np.iinfo(np.int64).min


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: float) -> tuple[DataFrame, int]:
    """Staged (id, label, v array<long>) of the rows that take part, and their length."""
    bounded_batches(df.sparkSession)
    x = F.col(vec_col).cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    small = F.aggregate(x, F.lit(0.0), lambda a, c: a + F.pow(F.floor(scale * c).cast("double"), 2)) < float(1 << 62)
    rows = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & (F.size(x) > 0))
    rows = rows.where(good).where(small).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.transform(x, lambda c: F.floor(scale * c)).alias("v"))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    dim = most["d"] if most else 0
    one = rows.where(F.size("v") == dim).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    return staged(one, "whole-vectors"), dim


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _codebook(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k centres of x by Lloyd's rounds; a centre that loses all its vectors stays where it was."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        code = _nearest(x, centre)
        count = np.bincount(code, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, code, x)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre * centre).sum(axis=1)[None, :] - 2 * (x @ centre.T), axis=1) if len(x) else np.zeros(0, np.int64)


class MultiIndex:
    """Codebooks with radii, cell counts and the shards of cells."""

    def __init__(self, centres: list[np.ndarray], half: int):
        self.centres, self.half = centres, half

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.half], x[:, self.half :]]

    def settle(self, radii: list[np.ndarray], counts: np.ndarray, shard_rows: int) -> None:
        """Take in the radius of every code, the rows of every cell, and deal cells to shards in order."""
        self.radii, self.counts = radii, counts
        before = np.cumsum(counts) - counts
        self.pieces = np.maximum(1, -(-counts // shard_rows))  # a large cell has shards of its own
        step = np.where(counts > shard_rows, 0, before // shard_rows)
        fresh = np.concatenate([[True], (step[1:] != step[:-1]) | (counts[1:] > shard_rows) | (counts[:-1] > shard_rows)])
        size = np.where(counts > shard_rows, self.pieces, 1) * fresh
        end = np.cumsum(size)
        self.first = np.where(counts > shard_rows, end - self.pieces, end - 1)

    def bounds(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Highest and lowest half score of each code for one anchor, rounded outward."""
        high, low = [], []
        for part, centre, radius in zip(self.parts(q[None, :]), self.centres, self.radii):
            score, reach = centre @ part[0], np.linalg.norm(part[0]) * radius
            slack = 1e-9 * (np.abs(score) + reach) + 1e-6
            high.append(score + reach + slack)
            low.append(score - reach - slack)
        return high, low

    def visit(self, q: np.ndarray, seen: int, rows: int, above: float = math.inf) -> tuple[list[int], int, float]:
        """(cells, cells seen, next bound): the next cells after the ``seen`` first, until they hold ``rows`` rows.

        Empty cells are passed over, as are those whose rows all score more than ``above``. The next bound is -inf at the end.
        """
        high, low = self.bounds(q)
        order = [np.argsort(-h, kind="stable") for h in high]
        u, w = high[0][order[0]].tolist(), high[1][order[1]].tolist()
        heap, popped = [(-(u[0] + w[0]), 0, 0)], [0] * (len(u) + 1)  # popped[i]: cells of row i that are out, always a prefix
        cells, at, held = [], 0, 0
        while heap and held < rows:
            _, i, j = heapq.heappop(heap)
            popped[i] = j + 1
            if j + 1 < len(w) and (i == 0 or popped[i - 1] > j + 1):
                heapq.heappush(heap, (-(u[i] + w[j + 1]), i, j + 1))
            if i + 1 < len(u) and popped[i + 1] == j:
                heapq.heappush(heap, (-(u[i + 1] + w[j]), i + 1, j))
            at += 1
            if at > seen:
                a, b = int(order[0][i]), int(order[1][j])
                cell = a * len(w) + b
                if self.counts[cell] and low[0][a] + low[1][b] <= above:
                    cells.append(cell)
                    held += int(self.counts[cell])
        return cells, at, -heap[0][0] if heap else -math.inf


def build(vectors: DataFrame, n: int, dim: int, seed: int, cell_rows: int, shard_rows: int) -> tuple[MultiIndex, DataFrame]:
    """The index, and all vectors as staged (shard, cell, id, label, v)."""
    k, vectors = max(1, min(MAX_CODES, round(math.sqrt(n / cell_rows)))), vectors.select("id", "label", "v")
    sample = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("v").toPandas()
    s, half = np.array(sample["v"].tolist(), dtype=np.float64), max(1, dim // 2)
    index = MultiIndex([], half)
    index.centres = [_codebook(part, k, seed + i) for i, part in enumerate(index.parts(s))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = index.parts(_matrix(batch.column(2)))
            code = [_nearest(p, c) for p, c in zip(parts, index.centres)]
            far = [np.sqrt(((p - c[i]) ** 2).sum(axis=1)) for p, c, i in zip(parts, index.centres, code)]
            extra = [pa.array(x) for x in (code[0], code[1], far[0], far[1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=["id", "label", "v", "a", "b", "far_a", "far_b"])

    schema = T.StructType([*vectors.schema.fields, *[T.StructField(c, T.LongType()) for c in "ab"], *[T.StructField(c, T.DoubleType()) for c in ("far_a", "far_b")]])
    coded = staged(vectors.mapInArrow(assign, schema), "coded-vectors")
    n_b, radii = len(index.centres[1]), []
    for c, size in (("a", len(index.centres[0])), ("b", n_b)):
        radius = np.zeros(size)
        for row in coded.groupBy(c).agg(F.max(f"far_{c}").alias("r")).collect():  # one row a code
            radius[row[c]] = row["r"] * (1 + 1e-9) + 1e-9
        radii.append(radius)
    counts = np.zeros(len(index.centres[0]) * n_b, np.int64)
    for row in coded.groupBy((F.col("a") * n_b + F.col("b")).alias("cell")).count().collect():  # one row a cell
        counts[row["cell"]] = row["count"]
    index.settle(radii, counts, shard_rows)
    places = vectors.sparkSession.createDataFrame([(c, int(index.first[c]), int(index.pieces[c])) for c in np.flatnonzero(counts).tolist()], "cell long, first long, pieces long")
    dealt = coded.withColumn("cell", F.col("a") * n_b + F.col("b")).join(F.broadcast(places), "cell")  # at most MAX_CODES squared rows
    shard = F.col("first") + F.pmod(F.xxhash64("id", F.lit(seed)), F.col("pieces"))
    return index, staged(dealt.select(shard.alias("shard"), "cell", "id", "label", "v"), "dealt-vectors")


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest entries of each row but NONE, and of all that tie with the last of them."""
    if score.shape[1] > k:
        edge = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
        return np.nonzero((score >= edge[:, None]) & (score > NONE))
    return np.nonzero(score > NONE)


def _meet(left: pa.Table, right: pa.Table, k: int, same_label: bool) -> pa.Table:
    """The k best of every anchor and window among the visited cells of one part of a shard."""
    names, empty = ["aid", "nth", "id", "score"], {"aid": [], "nth": [], "id": [], "score": []}
    if not left.num_rows or not right.num_rows:
        return pa.table(empty, schema=pa.schema([(c, pa.int64()) for c in names]))
    labels, code = np.unique(np.concatenate([np.asarray(left.column("label")), np.asarray(right.column("label"))]), return_inverse=True)
    mine, theirs = code[: left.num_rows], code[left.num_rows :]
    aid, ids = np.asarray(left.column("aid")), np.asarray(right.column("id"))
    q, x = _matrix(left.column("v")), _matrix(right.column("v"))
    if (q * q).sum(axis=1).max() * (x * x).sum(axis=1).max() >= float(1 << 104):  # products that doubles may round
        q, x = (np.array([r for r in t.column("v").to_pylist()], dtype=np.int64) for t in (left, right))
    windows = left.column("windows").to_pylist()
    low = np.array([[w["low"] for w in row] + [1] * (max(map(len, windows)) - len(row)) for row in windows], dtype=np.int64)
    high = np.array([[w["high"] for w in row] + [0] * (low.shape[1] - len(row)) for row in windows], dtype=np.int64)
    visits = left.column("cells").to_pylist()
    cell = np.asarray(right.column("cell"))
    by = theirs * (int(cell.max()) + 1) + cell if same_label else cell
    order = np.argsort(by, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], by[order][1:] != by[order][:-1], [True]]))
    here = {(int(theirs[order[a]]) if same_label else -1, int(cell[order[a]])): order[a:b] for a, b in zip(edges[:-1], edges[1:])}
    who: dict[tuple[int, int], list[int]] = {}
    for i, cells in enumerate(visits):
        for c in cells:
            who.setdefault((int(mine[i]) if same_label else -1, c), []).append(i)
    found: list[tuple[np.ndarray, ...]] = []
    for key, anchors in who.items():
        rows = here.get(key)
        if rows is None:
            continue
        a = np.array(anchors)
        score = (q[a] @ x[rows].T).astype(np.int64)
        score[aid[a][:, None] == ids[rows][None, :]] = NONE
        if not same_label:
            score[mine[a][:, None] == theirs[rows][None, :]] = NONE
        for nth in range(low.shape[1]):
            inside = np.where((score >= low[a, nth][:, None]) & (score <= high[a, nth][:, None]), score, NONE)
            i, j = _best(inside, k)
            found.append((a[i], np.full(len(i), nth), ids[rows[j]], inside[i, j]))
    a, nth, other, score = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((other, -score, nth, a))
    a, nth, other, score = a[order], nth[order], other[order], score[order]
    group = a * (low.shape[1] + 1) + nth
    keep = np.arange(len(a)) - np.searchsorted(group, group) < k
    return pa.table({"aid": aid[a[keep]], "nth": nth[keep].astype(np.int64), "id": other[keep], "score": score[keep]})


def _search(index: MultiIndex, dealt: DataFrame, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(aid, nth, id, score) of the k best rows of every window of ``anchors`` (aid, label, v, windows), exactly.

    Rounds end when no anchor is left whose next bound could still change its result.
    """
    spark, seed = dealt.sparkSession, 0
    shared = spark.sparkContext.broadcast(index)
    label_type = anchors.schema["label"].dataType.simpleString()
    open_schema = f"aid long, label {label_type}, v array<bigint>, windows array<struct<low:bigint,high:bigint>>"

    def planned(rows: int):
        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                q, at, shards, cells, seen, bound = _matrix(table.column("v")), [], [], [], [], []
                windows = table.column("windows").to_pylist()
                for i, before in enumerate(table.column("seen").to_pylist()):
                    above = max((w["high"] for w in windows[i]), default=-math.inf)
                    found, now, ahead = shared.value.visit(q[i], before, rows, above)
                    by: dict[int, list[int]] = {}
                    for c in found:
                        first = int(shared.value.first[c])
                        for p in range(first, first + int(shared.value.pieces[c])):
                            by.setdefault(p, []).append(c)
                    for shard, listed in [(-1, []), *by.items()]:  # -1: the anchor itself, for the next round
                        at.append(i)
                        shards.append(shard)
                        cells.append(listed)
                        seen.append(now)
                        bound.append(ahead)
                out = table.drop_columns(["seen"]).take(pa.array(at, pa.int64())).append_column("shard", pa.array(shards, pa.int64())).append_column("cells", pa.array(cells, pa.list_(pa.int64())))
                yield from out.append_column("seen", pa.array(seen, pa.int64())).append_column("bound", pa.array(bound, pa.float64())).combine_chunks().to_batches()

        return plan

    best = Window.partitionBy("aid", "nth").orderBy(F.col("score").desc(), "id")
    active, found, rows, done = anchors.withColumn("seen", F.lit(0).cast("long")), None, FIRST_ROWS, []
    while True:
        plan = staged(active.mapInArrow(planned(rows), f"{open_schema}, shard long, cells array<bigint>, seen long, bound double"), "visits")
        visits = plan.where("shard >= 0")
        cut = visits.groupBy("shard").agg(F.ceil(F.count("*") / ANCHOR_ROWS).cast("int").alias("parts"))
        x = dealt.join(cut, "shard").withColumn("pq", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("shard", "pq", "cell", "id", "label", "v")
        q = visits.join(cut.select(F.col("shard").alias("of"), "parts"), F.col("shard") == F.col("of"))
        q = q.select("of", F.pmod(F.xxhash64("aid", F.lit(seed)), F.col("parts")).cast("int").alias("part"), "aid", "label", "v", "windows", "cells")
        met = q.groupBy("of", "part").cogroup(x.groupBy("shard", "pq")).applyInArrow(lambda left, right: _meet(left, right, k, same_label), "aid long, nth long, id long, score long")
        pool = met if found is None else found.unionByName(met)
        pool = staged(pool.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k), "best")
        # an anchor goes on while some window is not full of scores above the next bound and not wholly above it
        last = pool.where(F.col("r") == k).groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("nth", "score"))).alias("last"))  # at most one entry a window
        heads = plan.where("shard < 0 and bound > double('-infinity')").join(last.withColumnRenamed("aid", "a"), F.col("aid") == F.col("a"), "left")
        unsure = F.exists(
            F.zip_with("windows", F.sequence(F.lit(0).cast("long"), F.size("windows").cast("long") - 1), lambda w, i: F.struct(w["low"].alias("low"), w["high"].alias("high"), F.col("last")[i].alias("last"))),
            lambda w: (w["low"] <= w["high"]) & (w["low"] <= F.col("bound")) & (w["last"].isNull() | (w["last"] <= F.col("bound"))),
        )
        active = staged(heads.where(unsure).select("aid", "label", "v", "windows", "seen"), "open-anchors")
        goes_on = active.select("aid").distinct()
        done.append(pool.join(goes_on, "aid", "left_anti").drop("r"))
        if active.isEmpty():
            break
        found, rows = pool.join(goes_on, "aid", "left_semi").drop("r"), rows * GROWTH
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return staged(out, "certain")


def mine(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", n_positives: int = 5, n_negatives: int = 3,
    low: int = 50, high: int = 95, scale: float = 256.0, seed: int = 3, cell_rows: int = CELL_ROWS, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A negative's score is ``low`` to ``high`` percent of the positive's.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    vectors, dim = whole_vectors(df, id_col, vec_col, label_col, scale)
    n = vectors.count()
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    index, dealt = build(vectors, n, dim, seed, cell_rows, shard_rows)
    asked = df.where(is_anchor & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    rows = staged(vectors.join(asked, "id", "left_semi").select(F.col("id").alias("aid"), "label", "v"), "anchors")
    whole = F.array(F.struct(F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high")))
    positives = _search(index, dealt, rows.withColumn("windows", whole), n_positives, same_label=True)
    place = F.row_number().over(Window.partitionBy("aid").orderBy(F.col("score").desc(), "id")) - 1
    positives = staged(positives.select("aid", place.cast("long").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 100 * negative within [low * positive, high * positive], in whole numbers without overflow
    floor_of = lambda percent: F.expr(f"(positive_score - pmod(positive_score, 100L)) div 100L * {percent}L + (pmod(positive_score, 100L) * {percent}L) div 100L")
    ceil_of = lambda percent: F.expr(f"(positive_score - pmod(positive_score, 100L)) div 100L * {percent}L + (pmod(positive_score, 100L) * {percent}L + 99L) div 100L")
    window = F.struct("nth", ceil_of(low).alias("low"), floor_of(high).alias("high"))
    windows = positives.groupBy("aid").agg(F.array_sort(F.collect_list(window)).alias("w"))  # at most n_positives a row
    windows = windows.select("aid", F.transform("w", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))).alias("windows"))
    negatives = _search(index, dealt, rows.join(windows, "aid"), n_negatives, same_label=False)
    order = Window.partitionBy("aid", "nth").orderBy(F.col("score").desc(), "id")
    negatives = negatives.select("aid", "nth", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.row_number().over(order).alias("rank"))
    return positives.join(negatives, ["aid", "nth"]).select(F.col("aid").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
