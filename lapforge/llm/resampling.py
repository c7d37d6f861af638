"""Quality classifier by importance resampling.

Two bag models over hashed word n-grams (unigrams and bigrams, ``buckets`` buckets): the
target, counted from labelled good documents, and the raw text, counted from all
documents. A document's log weight is the sum over its n-grams of the log ratio of the
two; ratios of buckets with little evidence are shrunk to 1 by ``prior`` pseudo-counts,
so the rule behaves alike at every size. Gumbel noise seeded by id is added, and the
top k documents are kept, k being the number of documents whose posterior of coming from
the target is at least one half (share of good labels times weight), allowing ``SLACK``
nats an n-gram for what sampling the labels leaves uncertain.

Labels: at most ``max_labels`` labelled rows are used, picked by a seeded hash of the id.
This is the one bounded sample; the raw model counts every document. What is broadcast is
that sample and one vector of ``buckets`` ratios. Counts are summed inside each task
before one shuffle of buckets; top-k is exact by a histogram of scores and a ranking of
the one histogram cell that holds the k-th score.

Edge cases: a null or empty text has log weight 0 and counts as raw text; labels that are
null are no labels; without any good label every weight is 0 and nothing is rejected; ties
of score go to the smaller id; rows with a repeated id get one noise value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged
from .wordhash import grams, spans, utf8_parts, words

BUCKETS = 1 << 16
MAX_LABELS = 20_000
PRIOR = 20.0
BLOCK_BYTES = 1 << 20
N_GRAMS = "n_grams"
SLACK = 0.02  # nats
CELL = 1024.0  # histogram cells of score per unit of its logarithm


def _features(column: pa.Array, buckets: int):
    """Yield (first row, end row, bucket of each n-gram, its row) for blocks of a text column."""
    data, offsets = utf8_parts(column)
    for a, b in spans(offsets, BLOCK_BYTES):
        value, _, _, ptr = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        pair, _, pair_ptr = grams(value, ptr, 2)
        rows = np.concatenate([np.repeat(np.arange(a, b), np.diff(ptr)), np.repeat(np.arange(a, b), np.diff(pair_ptr))])
        yield a, b, (np.concatenate([value, pair]) % np.uint64(buckets)).astype(np.int64), rows


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS, prior: float = PRIOR, max_labels: int = MAX_LABELS, seed: int = 11) -> tuple[np.ndarray, float]:
    """(log ratio of each bucket, share of good labels)."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_lid")).agg(F.max(label_col).alias("_label"))
        .orderBy(F.xxhash64("_lid", F.lit(seed)), "_lid").limit(max_labels)
    )
    chosen = staged(chosen, "labels")
    share = chosen.agg(F.avg(F.col("_label").cast("double"))).first()[0] or 0.0
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_lid"), "left").select("_text", F.coalesce(F.col("_label") == 1, F.lit(False)).alias("_good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            marks = np.asarray(batch.column(1))
            for _, _, bucket, rows in _features(batch.column(0), buckets):
                raw += np.bincount(bucket, minlength=buckets)
                good += np.bincount(bucket[marks[rows]], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(good[seen])], names=["bucket", "raw", "good"])

    counted = marked.mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    raw[counted["bucket"]], good[counted["bucket"]] = counted["raw"], counted["good"]
    if not good.sum():
        return np.zeros(buckets), share
    expected = raw * (good.sum() / raw.sum())
    return np.log((good + prior) / (expected + prior)), share


def log_weights(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", out_col: str = "log_weight", keep: list[str] | None = None) -> DataFrame:
    """Add the log weight and the number of n-grams of every row (a clashing column is replaced)."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (out_col, N_GRAMS)]
    carried = list(dict.fromkeys([*kept, text_col]))
    shared, buckets = docs.sparkSession.sparkContext.broadcast(ratio), len(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for a, b, bucket, rows in _features(batch.column(carried.index(text_col)), buckets):
                total[a:b] = np.bincount(rows - a, weights=shared.value[bucket], minlength=b - a)
                n[a:b] = np.bincount(rows - a, minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column(carried.index(c)) for c in kept] + [pa.array(n), pa.array(total)], names=[*kept, N_GRAMS, out_col])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(N_GRAMS, T.LongType()), T.StructField(out_col, T.DoubleType())])
    return docs.select(*carried).mapInArrow(score, schema)


def with_noise(scored: DataFrame, id_col: str, weight_col: str, seed: int) -> DataFrame:
    """Add ``score``: the log weight plus Gumbel noise seeded by the id."""
    uniform = (F.xxhash64(F.col(id_col), F.lit(seed)).bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    return scored.withColumn("score", F.col(weight_col) - F.log(-F.log(uniform)))


def top_k_rule(scored: DataFrame, k: int, id_col: str) -> Column:
    """A condition on (id, score) that holds for the k first by score, then smaller id."""
    if k <= 0:
        return F.lit(False)
    cell = F.floor(F.signum("score") * F.log1p(F.abs("score")) * CELL)  # no bound, however long the documents
    cells = scored.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0))
    edge = cells.withColumn("upto", upto).where(F.col("upto") >= k).orderBy("upto").first()
    if edge is None:
        return F.lit(True)
    left = k - (edge["upto"] - edge["n"])
    order = Window.orderBy(F.col("score").desc(), F.col(id_col).asc_nulls_last())
    last = scored.where(cell == edge["cell"]).select(id_col, "score", F.row_number().over(order).alias("r")).where(F.col("r") == left).first()
    tied = F.lit(True) if last[id_col] is None else F.coalesce(F.col(id_col) <= F.lit(last[id_col]), F.lit(False))
    return (F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & tied)


def choose(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, **kw) -> tuple[DataFrame, np.ndarray, Column]:
    """(scores, log ratios, rule): the scores of all rows, and the condition for those to keep."""
    ratio, share = fit(docs, labels, id_col, text_col, seed=seed, **kw)
    scored = staged(with_noise(log_weights(docs, ratio, text_col, keep=[id_col]), id_col, "log_weight", seed), "log-weights")
    likely = F.col("log_weight") + SLACK * F.col(N_GRAMS) >= float(np.log(0.5 / share)) if share else F.lit(True)
    return scored, ratio, top_k_rule(scored, scored.where(likely).count(), id_col)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(id, n_grams, log_weight, score, kept) of every row."""
    scored, _, rule = choose(docs, labels, id_col, text_col, **kw)
    return scored.withColumn("kept", rule)


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, **kw) -> DataFrame:
    """The rows of ``docs`` that the resampling keeps, with their columns; no join, the rule is a constant."""
    _, ratio, rule = choose(docs, labels, id_col, text_col, seed, **kw)
    plain = {c: f"_in{i}" for i, c in enumerate(docs.columns)}  # whatever the names of the input
    held = docs.select(F.col(id_col), F.col(text_col), *[F.col(c).alias(a) for c, a in plain.items() if c not in (id_col, text_col)])
    whole = with_noise(log_weights(held, ratio, text_col), id_col, "log_weight", seed).where(rule)
    return whole.select(*[F.col(c if c in (id_col, text_col) else a).alias(c) for c, a in plain.items()])
