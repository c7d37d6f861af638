"""Resampling documents towards a target by importance weights of hashed word n-grams.

Texts are cut at newlines, which separate words anyway. A distinct line's n-grams are taken
and hashed once for the whole table; bucket counts multiply them by the occurrences of the line, and a
document's weight adds up its lines' gains times the occurrences in it. N-grams that cross a line
end are no line's own: each document adds them separately (none for single words).

A bucket's gain is floor(1000 ln) of the ratio of its smoothed shares in target and raw text. A document's
weight is the floored mean of the gains of its n-grams, its score the weight plus floored Gumbel noise seeded
by the id. Of the documents with enough words the given percentage is drawn, the highest scores first.

Lines are told apart by 128 bits of a digest. What is broadcast is one whole number a bucket. Ranks
are counted in two steps: a histogram of the scores (whole numbers, so some ten thousand
rows however many documents) gives the score at which drawing ends, then the rows above are
range-partitioned by score, id and row, counted in each partition and offset by the partitions ahead.

Edge cases: null and empty texts have no n-grams, weight 0 and a score, and are never drawn unless ``min_words``
is 0; rows without an id are seeded by an empty one and come last among equal scores; rows that repeat an id are
documents of their own with equal noise; an empty target or table leaves counts of 0; columns of the input that
are not used play no part, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .common import staged
from .wordhash import utf8_parts

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # of lower-cased bytes
BUCKETS = 10_000


def _hashes(words: list[bytes], n_max: int, buckets: int) -> np.ndarray:
    """Bucket of every run of 1 to ``n_max`` consecutive words, joined by one space."""
    runs = [words]
    for k in range(2, n_max + 1):
        runs.append([b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)])
    return np.concatenate([np.fromiter(map(zlib.crc32, r), np.int64, len(r)) for r in runs]) % buckets


def _crossing(lines: list[list[bytes]], n_max: int, buckets: int) -> np.ndarray:
    """Bucket of every run of 2 to ``n_max`` words that holds words of two lines at least."""
    out: list[int] = []
    edge = n_max - 1
    words: list[bytes] = []  # the last words before the present line, at most ``edge`` of them
    for line in lines:
        near = words + line[:edge]
        for k in range(2, n_max + 1):
            for i in range(max(0, len(words) - k + 1), min(len(words), len(near) - k + 1)):
                out.append(zlib.crc32(b" ".join(near[i : i + k])))
        words = (words + line)[-edge:]
    return np.array(out, np.int64) % buckets


def _splitter(n_max: int, buckets: int) -> blocks.Split:
    def split(column: pa.Array):
        data, offsets = utf8_parts(column)
        raw, ids = data.tobytes().lower(), {}
        rows, crossing = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            lines = raw[a:b].split(b"\n")
            rows.append(np.fromiter((ids.setdefault(x, len(ids)) for x in lines), np.int64, len(lines)))
            if n_max > 1:
                crossing.append(_crossing([WORD.findall(x) for x in lines], n_max, buckets))
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        more = [np.array([len(c) for c in crossing], np.int64), np.concatenate(crossing)] if crossing else []
        return pa.array(list(ids), pa.binary()), *blocks.postings(row, np.concatenate(rows), np.ones(len(row)), len(rows), len(ids)), more

    return split


def _key(item: Column) -> Column:
    return F.unhex(F.md5(item))


class Features:
    """Lines and their n-gram buckets of one table: staged blocks, and staged distinct lines."""

    def __init__(self, df: DataFrame, text: Column, keep: list[Column], n_max: int, buckets: int):
        if n_max < 1 or buckets < 1:
            raise ValueError("n_max and buckets must be 1 or more")
        self.n_max, self.n_buckets = n_max, buckets
        self.blocks = blocks.factor(df, text, keep, _splitter(n_max, buckets), T.BinaryType(), occurs=True, label="line-blocks")

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = [WORD.findall(x) for x in batch.column(2).to_pylist()]
                found = [_hashes(w, n_max, buckets) for w in words]
                ptr = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                lists = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), lists], names=["key", "occurs", "n_words", "features"])

        lines = blocks.distinct(self.blocks, _key)
        self.lines = staged(lines.mapInArrow(features, "key binary, occurs long, n_words long, features array<int>"), "line-features")

    def counts(self) -> np.ndarray:
        """Number of n-grams of the whole table in each bucket: one number a bucket and task is shuffled."""
        n_buckets = self.n_buckets

        def summed(found: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]):
            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(n_buckets, np.int64)
                for batch in batches:
                    np.add.at(total, *found(batch))
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

            return add

        def of_lines(batch: pa.RecordBatch):
            lists = batch.column(1)
            return np.asarray(lists.flatten()).astype(np.int64), np.repeat(np.asarray(batch.column(0)), np.asarray(lists.value_lengths()))

        def crossing(batch: pa.RecordBatch):
            found = np.concatenate([blocks.unpack(x)[4] for x in batch.column(0).to_pylist()] or [np.zeros(0, np.int64)])
            return found, np.ones(len(found), np.int64)

        parts = self.lines.select("occurs", "features").mapInArrow(summed(of_lines), "bucket long, n long")
        if self.n_max > 1:
            parts = parts.unionByName(self.blocks.select("postings").mapInArrow(summed(crossing), "bucket long, n long"))
        out = np.zeros(n_buckets, np.int64)
        for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
            out[row["bucket"]] = row["n"]
        return out

    def weigh(self, gain: np.ndarray, keep: list[T.StructField]) -> DataFrame:
        """The kept columns of every row with n_words, n_features and the sum of the gains."""
        shared = self.blocks.sparkSession.sparkContext.broadcast(gain)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(2)
                size = np.asarray(lists.value_lengths()).astype(np.int64)
                upto = np.concatenate([[0], np.cumsum(shared.value[np.asarray(lists.flatten()).astype(np.int64)])])
                ends = np.cumsum(size)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(upto[ends] - upto[ends - size])], names=["key", "n_words", "n_features", "gain"])

        values = self.lines.select("key", "n_words", "features").mapInArrow(add, "key binary, n_words long, n_features long, gain long")
        names = ["n_words", "n_features", "gain"]

        def crossing(further: list[np.ndarray]) -> dict[str, np.ndarray]:
            if not further:
                return {}
            ends = np.cumsum(further[0])
            upto = np.concatenate([[0], np.cumsum(shared.value[further[1]])])
            return {"n_features": further[0], "gain": upto[ends] - upto[ends - further[0]]}

        return blocks.sums(self.blocks, blocks.joined_back(self.blocks, values, names, _key), keep, names, crossing)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the raw text."""
    n = float(len(raw))
    s, t = raw.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(id_col: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of a digest of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, k: int, drawable: Column, id_col: str) -> DataFrame:
    """``scored`` with rank 1 to ``k`` for the drawable rows of highest score (ties: smaller id), null for all others."""
    none = F.lit(None).cast("long")
    if k <= 0:
        return scored.withColumn("rank", none)
    counts = scored.where(drawable).groupBy(F.col("score").alias("at")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0))
    last = counts.withColumn("upto", upto).where(F.col("upto") >= k).agg(F.max("at")).first()[0]
    high = drawable & (F.col("score") >= last)
    spread = scored.where(high).repartitionByRange(F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("row"))
    spread = spread.sortWithinPartitions(F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("row"))
    schema = T.StructType([*scored.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            nth = pa.array(np.arange(seen + 1, seen + batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), nth], names=schema.names)
            seen += batch.num_rows

    numbered = staged(spread.mapInArrow(number, schema), "drawn")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("size"))  # one row a partition
    ahead = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = numbered.join(F.broadcast(sizes.select("part", ahead.alias("ahead"))), "part").withColumn("rank", F.col("ahead") + F.col("nth"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    rest = scored.where(~F.coalesce(high, F.lit(False))).withColumn("rank", none)
    return rest.unionByName(drawn.select(*rest.columns))


def resample(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    n_max: int = 1, buckets: int = BUCKETS, percent: int = 10, min_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row; rank is null for those not drawn."""
    raw = Features(df, F.col(text_col), [F.col(id_col), F.monotonically_increasing_id()], n_max, buckets)
    goal = Features(target, F.col(target_text_col), [], n_max, buckets)
    keep = [T.StructField("id", df.schema[id_col].dataType), T.StructField("row", T.LongType())]
    weighed = raw.weigh(gains(raw.counts(), goal.counts()), keep)
    weight = F.when(F.col("n_features") > 0, F.expr("gain div n_features - if(gain % n_features < 0, 1, 0)")).otherwise(0).cast("long")
    scored = staged(weighed.withColumn("weight", weight).withColumn("score", F.col("weight") + noise("id", seed)).drop("gain"), "scores")
    drawable = F.col("n_words") >= min_words
    k = percent * scored.where(drawable).count() // 100
    out = ranked(scored, k, drawable, "id")
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
