"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are lifted by one component so that all have the largest norm M, and queries are
scaled to M; then larger inner product means smaller Euclidean distance. A table hashes a
vector to floor((a.x + b) / w) for each of a few Gaussian directions a. For a neighbour at
distance R each slot offset has a known probability, so a query visits the perturbed
buckets of every table in order of their estimated success until the chance to have met the
neighbour in some table reaches ``success``. Candidates of all tables are merged and
reranked by the exact inner product in double precision.

Fitting reads a bounded sample (``SAMPLE`` vectors): R is the distance of the k-th neighbour
inside the sample, which is an overestimate for the whole table, and w = R. Every vector is
indexed. Buckets are unbounded: a bucket is cut into parts of about ``PART_ROWS`` vectors
and as many queries, every pair of parts is met, and each meeting gives only its best k; so
a hot vector never fills one task, and nothing is capped. A query with fewer than k found is
searched again against all parts, so the result has k rows a query whenever there are k.

Edge cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do null ids; ties go to the smaller id; rows that
repeat an id are one vector (the first in order); an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

TABLES, FUNCTIONS = 2, 3
REACH = 3  # slots on either side that probes may visit
SAMPLE, PART_ROWS = 4096, 4096


def _normal(x):
    return 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


class Index:
    """Hash functions of all tables, and the lift of vectors to one norm."""

    def __init__(self, dim: int, norm: float, radius: float, success: float, seed: int):
        rng = np.random.default_rng(seed)
        self.norm, self.radius, self.width = norm, radius, max(radius, 1e-9 * norm)
        self.direction = rng.standard_normal((dim + 1, TABLES * FUNCTIONS))
        self.shift = rng.uniform(0, self.width, TABLES * FUNCTIONS)
        self.per_table = 1 - (1 - success) ** (1 / TABLES)
        if self.per_table >= (2 * _normal(float(REACH)) - 1) ** FUNCTIONS:
            raise ValueError("success is more than the probes of REACH slots to either side can give")
        self.steps = np.array(list(itertools.product(range(-REACH, REACH + 1), repeat=FUNCTIONS)))

    def _slots(self, x: np.ndarray):
        at = (x @ self.direction + self.shift) / self.width
        slot = np.floor(at)
        return slot.astype(np.int64), at - slot

    @staticmethod
    def _key(table: int, slot: np.ndarray) -> np.ndarray:
        key = np.full(slot.shape[:-1], table, np.int64)
        for i in range(slot.shape[-1]):
            key = key * 65537 + slot[..., i] + 32768
        return key

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket of every vector in each table: (n, TABLES)."""
        lift = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        slot, _ = self._slots(np.column_stack([x, lift]))
        return np.column_stack([self._key(t, slot[:, t * FUNCTIONS : (t + 1) * FUNCTIONS]) for t in range(TABLES)])

    def probes(self, q: np.ndarray):
        """(query row, bucket) of the buckets to visit, best first within a query and table."""
        q = q * (self.norm / np.linalg.norm(q, axis=1))[:, None]
        slot, part = self._slots(np.column_stack([q, np.zeros(len(q))]))
        step = np.arange(-REACH, REACH + 1)
        low = (step[None, None, :] - part[:, :, None]) * self.width / self.radius
        chance = _normal(low + self.width / self.radius) - _normal(low)  # (n, functions, steps)
        rows, keys = [], []
        for t in range(TABLES):
            f = slice(t * FUNCTIONS, (t + 1) * FUNCTIONS)
            score = np.ones((len(q), len(self.steps)))
            for i in range(FUNCTIONS):
                score *= chance[:, f][:, i][:, self.steps[:, i] + REACH]
            order = np.argsort(-score, axis=1)
            reached = np.cumsum(np.take_along_axis(score, order, axis=1), axis=1)
            visits = np.minimum((reached < self.per_table).sum(axis=1) + 1, len(self.steps))
            row, nth = np.nonzero(np.arange(len(self.steps))[None, :] < visits[:, None])
            rows.append(row)
            keys.append(self._key(t, slot[row][:, f] + self.steps[order[row, nth]]))
        return np.concatenate(rows), np.concatenate(keys)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def clean(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, v array<double>) of the vectors that take part, and their length."""
    v = F.col(vec_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = df.where(F.col(id_col).isNotNull() & v.isNotNull()).select(F.col(id_col).alias("id"), v.alias("v"), good.alias("good")).where("good").drop("good")
    most = ok.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    dim = most["d"] if most else 0
    return staged(ok.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")), "vectors"), dim


def _best(k: int):
    """Top k of every query of a part of queries against a part of vectors."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        qid, ids = np.asarray(left.column("qid")), np.asarray(right.column("id"))
        if not len(qid) or not len(ids):
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, x = _matrix(left.column("v")), _matrix(right.column("v"))
        rows = []
        for a in range(0, len(q), 256):
            near = q[a : a + 256] @ x.T
            near[qid[a : a + 256, None] == ids[None, :]] = -np.inf
            if near.shape[1] > k:
                edge = -np.partition(-near, k - 1, axis=1)[:, k - 1]
                wide = near >= (edge - 1e-9 * np.maximum(np.abs(edge), 1))[:, None]  # all that may tie
            else:
                wide = np.ones(near.shape, bool)
            i, j = np.nonzero(wide & (near > -np.inf))
            exact = np.einsum("ij,ij->i", q[a + i], x[j])  # the same sum for equal vectors
            order = np.lexsort((ids[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.searchsorted(i, np.arange(len(near)))
            keep = np.arange(len(i)) - first[i] < k
            rows.append((qid[a + i[keep]], ids[j[keep]], exact[keep]))
        cols = [np.concatenate(c) for c in zip(*rows)]
        return pa.table({"qid": pa.array(cols[0]), "id": pa.array(cols[1]), "score": pa.array(cols[2])})

    return run


def _meet(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Candidates (qid, id, score): (key, id, v) and (key, qid, v) met bucket by bucket in bounded parts."""
    parts = lambda df, name: df.groupBy("key").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias(name))
    cut = staged(parts(vectors, "nv").join(parts(queries, "nq"), "key"), "bucket-parts")
    split = lambda id_col, n: F.pmod(F.xxhash64(id_col), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = vectors.join(cut, "key").select("key", split("id", "nv").alias("pv"), spread("nq").alias("pq"), "id", "v")
    q = queries.join(cut, "key").select("key", spread("nv").alias("pv"), split("qid", "nq").alias("pq"), "qid", "v")
    by = ["key", "pv", "pq"]
    return q.groupBy(*by).cogroup(x.groupBy(*by)).applyInArrow(_best(k), "qid long, id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return found.dropDuplicates(["qid", "id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", success: float = 0.97, seed: int = 5) -> DataFrame:
    """(query_id, rank, <id>, score) of the k nearest found of every query row, among all other rows."""
    vectors, dim = clean(df, id_col, vec_col)
    n = vectors.count()
    asked = df.where(is_query & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    queries = staged(vectors.join(asked, "id", "left_semi"), "queries")
    one = lambda frame, name: frame.select(F.lit(0).cast("long").alias("key"), F.col("id").alias(name), "v")
    if not n:
        out = _ranked(_meet(one(vectors, "id"), one(queries, "qid"), k), k)
    else:
        sample = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).toPandas()  # a bounded sample, for one distance
        s = np.array(sample["v"].tolist())
        norm = math.sqrt(vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]) * (1 + 1e-12)
        probe = s[: SAMPLE // 8]
        unit = probe / np.linalg.norm(probe, axis=1)[:, None]
        nearest = -np.partition(-(unit @ s.T), min(k, len(s) - 1), axis=1)[:, min(k, len(s) - 1)]
        radius = math.sqrt(max(1e-12, 2 * norm * norm - 2 * norm * float(np.median(nearest))))
        index = Index(dim, norm, radius, success, seed)

        def hash_all(batches):
            for batch in batches:
                keys = index.buckets(_matrix(batch.column(1)))
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), batch.column(0), batch.column(1)], names=["key", "id", "v"])

        def hash_queries(batches):
            for batch in batches:
                row, key = index.probes(_matrix(batch.column(1)))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(at), batch.column(1).take(at)], names=["key", "qid", "v"])

        hashed = vectors.select("id", "v").mapInArrow(hash_all, "key long, id long, v array<double>")
        asked = queries.select("id", "v").mapInArrow(hash_queries, "key long, qid long, v array<double>")
        out = staged(_ranked(_meet(hashed, asked, k), k), "neighbours")
        full = out.groupBy("qid").count().where(F.col("count") >= k).select(F.col("qid").alias("id"))
        short = staged(queries.join(full, "id", "left_anti"), "short-queries")
        if not short.isEmpty():
            again = _ranked(_meet(one(vectors, "id"), one(short, "qid"), k), k)
            out = out.join(short.select(F.col("id").alias("qid")), "qid", "left_anti").unionByName(again)
    return out.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
