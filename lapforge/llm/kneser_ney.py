"""Scoring with an interpolated modified Kneser-Ney bigram model.

Counting runs in Spark: every task reduces its texts to distinct bigrams, packed by shard
into binary columns (first words with their run lengths, second words, counts); a shard,
dealt by the first word, is merged by one task. Contexts that hold over a
``HOT_SHARE``-th of all tokens (at most HOT_SHARE words, so a bounded broadcast) are dealt
by both words, so no context lands in one shard.

Model: for each shard one sorted array of bigram hashes with their counts; for the words
sorted hash arrays of count, continuation count, context total and the numbers of
followers seen once, twice and more often. They are written to the shared folder by the
tasks that made them, under final names by an atomic rename (a repeated task rewrites the
same bytes), and memory-mapped by the scoring tasks; nothing passes through the driver.

p(w|v) = (c(vw) - D[c]) / c(v) + gamma(v) p(w); p(w) = (a(w) - D'[a]) / A + gamma' / (V + 1),
a being the number of distinct words before w, discounts from counts of counts (with the
usual fallback of 0.5 where a count of counts is 0). A context never seen backs off to
p(w). Every text starts after a begin mark and ends with an end token.

Edge cases: a null or empty text scores its end token alone; with no training text every
token has the uniform probability 1/(V+1) = 1; repeated rows count again; words are told
apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import find, map_array, put_array
from .common import shards_for, shared_dir, staged
from .wordhash import mix, spans, utf8_parts, words

BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
HOT_SHARE, LEAST_DISCOUNT = 1000, 0.05
BLOCK_BYTES, SHARD_BYTES = 1 << 21, 24 << 20
U64 = np.uint64


def tokens(column: pa.Array):
    """Blocks of (first row, end row, token hashes with begin marks and ends, row_ptr)."""
    data, offsets = utf8_parts(column)
    for a, b in spans(offsets, BLOCK_BYTES):
        value, _, _, ptr = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
        at = ptr + 2 * np.arange(b - a + 1)  # two marks more a row
        out = np.empty(at[-1], dtype=U64)
        out[at[:-1]], out[at[1:] - 1] = BEGIN, END
        inner = np.ones(at[-1], dtype=bool)
        inner[at[:-1]] = inner[at[1:] - 1] = False
        out[inner] = value
        yield a, b, out, at


def _pairs(token: np.ndarray, at: np.ndarray):
    """(context, token) of every scored token: all but the begin marks."""
    second = np.ones(len(token), dtype=bool)
    second[at[:-1]] = False
    i = np.flatnonzero(second)
    return token[i - 1], token[i]


def _counts(keys: np.ndarray, counts: np.ndarray | None = None):
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * U64(0x9E3779B97F4A7C15) + mix(second))


def _shard(first: np.ndarray, second: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    out = first % U64(n)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, first), len(hot) - 1)
        is_hot = hot[at] == first
        out[is_hot] = (mix(first[is_hot]) + second[is_hot]) % U64(n)
    return out.astype(np.int64)


# --- counting ----------------------------------------------------------------------


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, token, at in tokens(batch.column(0)):
            k, c = _counts(_pairs(token, at)[1])
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["h", "c"])


def _pack_bigrams(hot: np.ndarray, n_shards: int):
    def pack(first, second, count):
        shard = _shard(first, second, hot, n_shards)
        order = np.lexsort((second, first, shard))
        first, second, count, shard = first[order], second[order], count[order], shard[order]
        cut = np.searchsorted(shard, np.arange(n_shards + 1))
        rows = [[], [], [], [], []]
        for s in np.flatnonzero(np.diff(cut)):
            f = first[cut[s] : cut[s + 1]]
            start = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
            run = np.diff(np.append(start, len(f))).astype(np.uint32)
            c = count[cut[s] : cut[s + 1]]
            c = c.astype(np.uint8 if c.max() < 256 else np.uint32)
            for out, x in zip(rows, (int(s), f[start].tobytes(), run.tobytes(), second[cut[s] : cut[s + 1]].tobytes(), c.tobytes())):
                out.append(x)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32())] + [pa.array(x, pa.binary()) for x in rows[1:]], names=["shard", "first", "runs", "second", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for _, _, token, at in tokens(batch.column(0)):
                held.append((*_pairs(token, at), None))
                if sum(len(h[0]) for h in held) > 1_500_000:  # about 9 MB of text
                    yield pack(*_fold(held))
                    held = []
        if held:
            yield pack(*_fold(held))

    return run


def _fold(held: list[tuple]):
    first, second = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    count = None if held[0][2] is None else np.concatenate([h[2] for h in held])
    key = pair_key(first, second)
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.diff(np.append(start, len(key))) if count is None else np.add.reduceat(count[order], start) if len(start) else count[:0]
    return first[order][start], second[order][start], total


def _merge_shard(base: str):
    """Merge one shard, write its arrays, return its part of the word table and its counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        held = []
        for f, r, s, c in zip(*(table.column(x).to_pylist() for x in ("first", "runs", "second", "counts"))):
            second = np.frombuffer(s, U64)
            first = np.repeat(np.frombuffer(f, U64), np.frombuffer(r, np.uint32))
            held.append((first, second, np.frombuffer(c, np.uint8 if len(c) == len(second) else np.uint32).astype(np.int64)))
        first, second, count = _fold(held)
        key = pair_key(first, second)  # _fold leaves them in order of the key
        put_array(f"{base}/bigram-{shard}.key", key)
        put_array(f"{base}/bigram-{shard}.count", count.astype(np.int64))
        order = np.argsort(first, kind="stable")
        f, c = first[order], count[order]
        start = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
        parts = [np.add.reduceat(x.astype(np.int64), start) for x in (c, c == 1, c == 2, c >= 3)]
        w, a = _counts(second)
        n, m = len(start), len(w)
        zero_n, zero_m = np.zeros(n, np.int64), np.zeros(m, np.int64)
        cols = [np.concatenate([f[start], w]).view(np.int64), np.concatenate([zero_n, a])] + [np.concatenate([p, zero_m]) for p in parts]
        coc = [int((count == i).sum()) for i in (1, 2, 3, 4)]
        cols += [np.concatenate([[x], np.zeros(n + m - 1, np.int64)]) for x in coc]
        cols.append(np.full(n + m, shard, np.int64))
        return pa.Table.from_arrays([pa.array(x) for x in cols], names=["h", "a", "s", "n1", "n2", "n3", "k1", "k2", "k3", "k4", "shard"])

    return run


def _write_words(base: str):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        h = np.asarray(table.column("h")).view(U64)
        order = np.argsort(h)
        put_array(f"{base}/word-{shard}.key", h[order])
        cols = [np.asarray(table.column(x))[order] for x in ("c", "a", "s", "n1", "n2", "n3")]
        put_array(f"{base}/word-{shard}.stats", np.stack(cols, axis=1).astype(np.int64))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(h)], pa.int64())})

    return run


def _discounts(n1, n2, n3, n4) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more.

    Where counts of counts are missing or out of order (many texts in the same number of
    copies), an estimate may be 0 or less, which would leave nothing to unseen words; then it is 0.5.
    """
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [0.0, 1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 0.5, 3 - 4 * y * n4 / n3 if n3 and n4 else 0.5]
    return np.array([0.0] + [x if LEAST_DISCOUNT <= x <= i else 0.5 for i, x in enumerate(d) if i])


def fit(train: DataFrame, text_col: str = "text", n_shards: int | None = None) -> dict:
    """Count a model over all rows; returns its description (paths and a few scalars)."""
    spark = train.sparkSession
    base = f"{shared_dir(spark)}/lapforge/kn-{uuid.uuid4().hex}"
    texts = train.select(F.col(text_col).alias("text"))
    n_shards = n_shards or shards_for(texts, "text", SHARD_BYTES)
    uni = staged(texts.mapInArrow(_unigrams, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "kn-unigrams")
    total, vocabulary = uni.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = uni.where(F.col("c") * HOT_SHARE > total).select("h").toPandas()["h"].to_numpy(np.int64).view(U64)  # at most HOT_SHARE rows
    hot = np.sort(np.append(frequent, BEGIN))
    packed = texts.mapInArrow(_pack_bigrams(hot, n_shards), "shard int, first binary, runs binary, second binary, counts binary")
    stats = "h long, a long, s long, n1 long, n2 long, n3 long, k1 long, k2 long, k3 long, k4 long, shard long"
    merged = staged(packed.groupBy("shard").applyInArrow(_merge_shard(base), stats), "kn-stats")
    k = merged.agg(*[F.coalesce(F.sum(f"k{i}"), F.lit(0)) for i in (1, 2, 3, 4)]).first()
    sums = ["a", "s", "n1", "n2", "n3"]
    table = merged.select("h", F.lit(0).cast("long").alias("c"), *sums).unionByName(uni.select("h", "c", *[F.lit(0).cast("long").alias(x) for x in sums]))
    table = staged(table.groupBy("h").agg(*[F.sum(x).alias(x) for x in ["c", *sums]]), "kn-words")
    m = table.agg(F.coalesce(F.sum("a"), F.lit(0)), *[F.coalesce(F.sum(F.when(F.col("a") == i, 1)), F.lit(0)) for i in (1, 2, 3, 4)], F.coalesce(F.sum((F.col("a") >= 3).cast("long")), F.lit(0))).first()
    written = table.withColumn("shard", F.pmod("h", F.lit(n_shards)).cast("int")).groupBy("shard").applyInArrow(_write_words(base), "shard int, n long")
    words_in = {r["shard"] for r in written.collect()}  # one row a shard
    shards = {r[0] for r in merged.select("shard").distinct().collect()}  # one row a shard
    low = _discounts(*m[1:5])
    gamma = (low[1] * m[1] + low[2] * m[2] + low[3] * m[5]) / m[0] if m[0] else 1.0
    return {"base": base, "n_shards": n_shards, "bigram_shards": shards, "word_shards": words_in, "hot": hot, "total": total, "vocabulary": vocabulary, "high": _discounts(*k), "low": low, "types": m[0], "uniform": gamma / (vocabulary + 1)}


# --- scoring -----------------------------------------------------------------------


class Model:
    """The mapped arrays of one model in one worker."""

    def __init__(self, about: dict):
        self.__dict__.update(about)
        self.mapped: dict[str, np.ndarray] = {}

    def _array(self, name: str, dtype) -> np.ndarray:
        if name not in self.mapped:
            self.mapped[name] = map_array(f"{self.base}/{name}", dtype)
        return self.mapped[name]

    def word_stats(self, h: np.ndarray) -> np.ndarray:
        """Rows (c, a, s, n1, n2, n3) of sorted distinct words; zeros if unseen."""
        out = np.zeros((len(h), 6), np.int64)
        if not self.total:
            return out
        shard = np.mod(h.view(np.int64), self.n_shards)  # as pmod on signed values
        for s in np.unique(shard).tolist():
            if s not in self.word_shards:
                continue
            rows = np.flatnonzero(shard == s)
            key = self._array(f"word-{s}.key", U64)
            at, hit = find(key, h[rows])
            out[rows[hit]] = self._array(f"word-{s}.stats", np.int64).reshape(-1, 6)[at[hit]]
        return out

    def pair_counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key, shard = pair_key(first, second), _shard(first, second, self.hot, self.n_shards)
        out = np.zeros(len(key), np.int64)
        order = np.lexsort((key, shard))
        cut = np.searchsorted(shard[order], np.arange(self.n_shards + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            if s not in self.bigram_shards:
                continue
            rows = order[cut[s] : cut[s + 1]]
            at, hit = find(self._array(f"bigram-{s}.key", U64), key[rows])
            out[rows[hit]] = self._array(f"bigram-{s}.count", np.int64)[at[hit]]
        return out

    def score(self, column: pa.Array):
        """Per row: n_tokens, n_known, base score and model score."""
        n, known, base, score = (np.zeros(len(column), t) for t in (np.int64, np.int64, float, float))
        for a, b, token, at in tokens(column):
            first, second = _pairs(token, at)
            vocab, place = np.unique(np.concatenate([first, second]), return_inverse=True)
            v, w = place[: len(first)], place[len(first) :]
            pair = v.astype(np.int64) * len(vocab) + w
            _, one, back = np.unique(pair, return_index=True, return_inverse=True)
            count = self.pair_counts(first[one], second[one])
            c, cont, total, n1, n2, n3 = self.word_stats(vocab).T
            lower = np.maximum(cont - self.low[np.minimum(cont, 3)], 0) / max(self.types, 1) + self.uniform
            gamma = np.where(total > 0, (self.high[1] * n1 + self.high[2] * n2 + self.high[3] * n3) / np.maximum(total, 1), 1.0)
            v1, w1 = v[one], w[one]
            p = np.maximum(count - self.high[np.minimum(count, 3)], 0) / np.maximum(total[v1], 1) + gamma[v1] * lower[w1]
            row = np.repeat(np.arange(b - a), np.diff(at) - 1)
            unigram = np.log10((c + 0.1) / (self.total + 0.1 * (self.vocabulary + 1)))
            n[a:b] = np.diff(at) - 1
            known[a:b] = np.bincount(row, weights=(c > 0)[w], minlength=b - a)
            base[a:b] = np.bincount(row, weights=unigram[w], minlength=b - a)
            score[a:b] = np.bincount(row, weights=np.log10(p)[back], minlength=b - a)
        return n, known, base, score


def score(df: DataFrame, about: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row; perplexity is 10 ** (-score / n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(about)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(x) for x in model.score(batch.column(1))], names=["id", "n_tokens", "n_known", "base_score", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str) -> Column:
    """Whether the crc32 of the id as text is divisible by 10."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows that are not held out, score all rows."""
    about = fit(docs.where(~held_out(id_col)), text_col)
    out = score(docs, about, id_col, text_col)
    return out.select(
        id_col, held_out(id_col).alias("held_out"), "n_tokens", "n_known", F.lit(about["total"]).cast("long").alias("train_tokens"), "base_score", "score",
    )
