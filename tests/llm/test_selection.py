"""Hard negatives, target resampling and token counts against brute force, on small hostile tables."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lapforge.llm import blocks, hard_negatives, queries, target_resampling, token_counts

CLASH = ("id", "n", "block", "items", "occurs", "ptr", "at", "key", "text2", "n_tokens", "n_bytes", "over_limit", "score", "rank", "weight", "row", "keep_0", "v", "shard", "cell", "aid", "parts")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


# ---- token counts


@pytest.fixture(scope="module")
def source():
    return token_counts.load(public_tokenizers.path("word_bpe_49k.json"))


TEXTS = [
    None, "", " \t\n\x0b\f\r ", "Hello world, it's DON'T 1234!", "a<|endoftext|>b <|startoftext|><|endoftext|> <|ENDOFTEXT|>", "<|endof text|>",
    "non\xa0breaking　wide\x85next\x1csep", "é ́x Å 가 ﬁ Å", "İstanbul ΣΑΣ ẞ \U0001d518", "\U0001f697\U0001f697'll 've'S", "é" * 700, "x" * 3000 + " " + "ab'" * 500,
    "word " * 900, "A\nB\r\nC\tD", "\x00\x01 \x7f", "don't don't don't", "the <|endoftext|>", "क्ष กำ",
]


def test_token_counts_equal_the_library(spark, source):
    rows = [(None if i == 3 else i % 11, t) for i, t in enumerate(TEXTS * 3)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = token_counts.count_tokens(df, source, keep=["doc_id"], limit=500)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    lib = Tokenizer.from_str(source)
    want = Counter()
    for i, t in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 500)] += 1
    assert Counter(map(tuple, got.collect())) == want
    by_text = token_counts.count_tokens(df, source, keep=["text", "n_tokens"])  # a clashing column gives way
    assert by_text.columns == ["text", "n_bytes", "n_tokens", "over_limit"] and by_text.count() == len(rows)


def test_token_counts_of_random_texts(spark, source):
    rng = random.Random(8)
    alphabet = "aAbé'stx <|>endoftext1\n\t\xa0́가Σİ"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))) for i in range(400)]
    lib = Tokenizer.from_str(source)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), source).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_distinct_pieces_are_counted_once(spark, source):
    df = spark.createDataFrame([(i, "alpha beta alpha") for i in range(50)] + [(99, "beta gamma<|endoftext|>")], "doc_id long, text string").repartition(6)
    frequencies = token_counts.piece_frequencies(df, source, F.col("text"), [F.col("doc_id")])
    asked = spark.sparkContext.accumulator(0)

    def count(pieces):
        asked.add(len(pieces))
        return [len(p) for p in pieces]

    rows = blocks.counted_back(frequencies, count).collect()
    held = {(r["block"], nth): n for r in rows for nth, n in zip(np.cumsum(blocks.unpack(r["packed"])[0]), blocks.unpack(r["packed"])[1])}
    assert asked.value == 4  # alpha, beta, gamma and the special string
    items = {(r["block"], i): len(x) for r in frequencies.collect() for i, x in enumerate(r["items"])}
    assert held == items and len(frequencies.collect()) > 1


def test_packing():
    rng = np.random.default_rng(0)
    arrays = [rng.integers(0, 2**32 - 1, 1000), np.zeros(0, np.int64), np.arange(3)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks.unpack(blocks.pack(*arrays)), arrays))
    assert [len(x) for x in blocks.unpack(blocks.pack(arrays[1]))] == [0]


def test_token_counts_edges(spark, source):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), source).count() == 0
    broken = spark.createDataFrame([(1, bytearray(b"ab \xff\xfe cd"))], "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
    row = token_counts.count_tokens(broken, source).first()
    lib = Tokenizer.from_str(source)
    assert row["n_bytes"] == 8 and row["n_tokens"] == len(lib.encode("ab �� cd", add_special_tokens=False).ids)
    with pytest.raises(ValueError):
        token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))  # its pre-tokens keep the space


# ---- target resampling

RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def runs(text, n_max):
    w = RUN.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, n_max + 1) for i in range(len(w) - k + 1)]


def brute_resample(rows, target, n_max, buckets, percent, min_words, seed):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(h % buckets for h in runs(text, n_max)[1])
    for text in target:
        t.update(h % buckets for h in runs(text, n_max)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        n_words, f = runs(text, n_max)
        weight = sum(gain[h % buckets] for h in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    ranks = {id(r): n + 1 for n, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r, ranks.get(id(r))) for r in out]


def prose(rng, vocab, n_lines):
    return "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 6))) for _ in range(n_lines))


@pytest.mark.parametrize("n_max,percent,min_words", [(1, 10, 20), (2, 35, 5), (4, 100, 0)])
def test_resampling_equals_brute_force(spark, n_max, percent, min_words):
    rng = random.Random(n_max)
    vocab = ["The", "cat", "déjà", "x1", "A-b", "線", "run", "…", "zebra", "of", "it's"] + [f"w{i}" for i in range(40)]
    licence = "Permission is hereby granted\nto any person\n"
    rows = [(i, licence + prose(rng, vocab, rng.randint(0, 12))) for i in range(60)] + [(i, prose(rng, vocab, 9)) for i in range(100, 160)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "one"), (204, "cat\nrun\nof\nzebra\n\nThe"), (205, " ".join(rng.choice(vocab) for _ in range(4000)))]
    target = [prose(rng, vocab[:12], 8) for _ in range(20)] + [None, ""]
    want = brute_resample(rows, target, n_max, 500, percent, min_words, 2024)
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = target_resampling.resample(docs, goal, n_max=n_max, buckets=500, percent=percent, min_words=min_words)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_resampling_of_repeated_and_missing_ids(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)]
    text = prose(rng, vocab, 12)
    rows = [(7, text)] * 40 + [(None, text)] * 40 + [(i, prose(rng, vocab, 12)) for i in range(40)]
    got = target_resampling.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark.createDataFrame([("w1 w2",)], "text string"), percent=60).collect()
    want = brute_resample(rows, ["w1 w2"], 1, 10_000, 60, 20, 2024)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], r[5] or 0)
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))


def test_resampling_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert target_resampling.resample(empty, one).count() == 0
    row = target_resampling.resample(one, empty, n_max=2).first()
    assert (row["n_features"], row["rank"]) == (5, None)
    with pytest.raises(ValueError):
        target_resampling.resample(one, one, n_max=0)


def test_lines_are_hashed_once(spark):
    df = spark.createDataFrame([(i, "same line here\nother") for i in range(30)], "doc_id long, text string").repartition(5)
    lines = target_resampling.Features(df, F.col("text"), [], 1, 100).lines
    assert sorted((r["occurs"], r["n_words"]) for r in lines.collect()) == [(30, 1), (30, 3)]


# ---- hard negatives


def brute_mine(rows, is_anchor, n_positives, n_negatives, low, high, scale=256.0):
    kept = {}
    sizes = Counter(len(v) for i, v, label in rows if i is not None and v is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v))
    if not sizes:
        return []
    dim = min(sizes, key=lambda d: (-sizes[d], d))
    for i, v, label in rows:
        if i is None or v is None or label is None or len(v) != dim or not all(x is not None and math.isfinite(x) for x in v):
            continue
        whole = [math.floor(scale * x) for x in v]
        kept[i] = min(kept.get(i, (label, whole)), (label, whole))
    ids = sorted(kept)
    m = np.array([kept[i][1] for i in ids], dtype=np.int64)
    out = []
    for at, i in enumerate(ids):
        if not is_anchor(i):
            continue
        score = (m @ m[at]).tolist()
        order = sorted((-score[j], ids[j], j) for j in range(len(ids)) if j != at)
        same = [(j, -s) for s, _, j in order if kept[ids[j]][0] == kept[i][0]][:n_positives]
        for p, ps in same:
            fit = [(ids[j], -s) for s, _, j in order if kept[ids[j]][0] != kept[i][0] and low * ps <= -100 * s <= high * ps][:n_negatives]
            out += [(i, ids[p], r + 1, n, ps, ns) for r, (n, ns) in enumerate(fit)]
    return sorted(out)


def clustered(rng, n, dim, n_clusters):
    centre = rng.standard_normal((n_clusters, dim))
    of = rng.integers(0, n_clusters, n)
    x = centre[of] + 0.2 * rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, [float(np.float32(c)) for c in v], int(rng.integers(0, 4))) for i, v in enumerate(x)]


@pytest.mark.parametrize("cell_rows,shard_rows,low,high", [(8, 40, 50, 95), (3, 1000, 80, 99), (10_000, 64, 0, 100)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, cell_rows, shard_rows, low, high):
    monkeypatch.setattr(hard_negatives, "FIRST_ROWS", 30)
    monkeypatch.setattr(hard_negatives, "GROWTH", 3)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 7)
    rng = np.random.default_rng(cell_rows)
    rows = clustered(rng, 400, 10, 12)
    rows += [(1000 + i, rows[3][1], i % 4) for i in range(60)]  # ties
    rows += [(2000, None, 1), (2001, rows[0][1], None), (2002, [float("nan")] * 10, 1), (2003, [float("inf")] + [0.0] * 9, 1), (2004, [None] + [0.1] * 9, 2), (2005, [0.5] * 4, 1), (None, rows[1][1], 1), (2006, [], 0)]
    rows += [(2007, [0.0] * 10, 0), (5, rows[9][1], 0), (5, rows[5][1], 3), (2008, [-3.0] * 10, 2), (2100, [2e4] * 10, 1)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4))
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, low=low, high=high, cell_rows=cell_rows, shard_rows=shard_rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_mine(rows, lambda i: i % 10 == 0, 5, 3, low, high)


def test_cells_come_in_order_of_their_bounds_and_search_stops(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((40, 16)) * 100
    x = np.rint(centre[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 16)))
    df = spark.createDataFrame([(i, [int(c) for c in v], 0) for i, v in enumerate(x)], "id long, v array<long>, label int")
    index, dealt = hard_negatives.build(df, len(x), 16, 1, 8, 100)
    rows = dealt.collect()
    assert len(rows) == 3000 and max(Counter(r["shard"] for r in rows).values()) <= 2 * 100 + max(index.counts)
    cell_of = {r["id"]: r["cell"] for r in rows}
    q = x[17]
    cells, seen, bound = index.visit(q, 0, 10**9)
    assert bound == -math.inf and seen == len(index.counts) and sorted(cells) == np.flatnonzero(index.counts).tolist()
    high, low = index.bounds(q)
    n_b = len(index.centres[1])
    sums = [high[0][c // n_b] + high[1][c % n_b] for c in cells]
    assert sums == sorted(sums, reverse=True)
    for i, v in enumerate(x):
        a, b = divmod(cell_of[i], n_b)
        assert low[0][a] + low[1][b] <= v @ q <= high[0][a] + high[1][b]
    best = sorted((v @ q for v in x), reverse=True)[20]
    first, _, ahead = index.visit(q, 0, 400)
    assert ahead < best and sum(index.counts[first]) < 600  # a fraction of the rows makes the 20 nearest certain
    more, again, _ = index.visit(q, len(first) and index.visit(q, 0, 400)[1], 300)
    assert not set(first) & set(more) and again > 0


def test_hard_negatives_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(empty, F.col("vec_id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(alone, F.col("vec_id") == 0).count() == 0  # no positive
    nobody = hard_negatives.mine(alone, F.col("vec_id") < 0)
    assert nobody.count() == 0


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.integers(-(2**18), 2**18, 6) * 1.0], i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 9 == 0).collect())) == brute_mine(rows, lambda i: i % 9 == 0, 5, 3, 50, 95)


def test_queries_of_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    emb = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in emb]
    assert sorted(map(tuple, queries.op11_hard_negatives(spark, sf).collect())) == brute_mine(rows, lambda i: i % 50 == 0, 5, 3, 50, 95)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [(i, n, w, s, r) for i, _, n, w, s, r in brute_resample(docs, bench, 1, 10_000, 10, 20, 2024)]
    assert sorted(map(tuple, queries.op12_target_resampling(spark, sf).collect())) == sorted(want)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in docs}
    got = queries.op13_token_counts(spark, sf).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert unicodedata.normalize("NFC", "é") == "é"
