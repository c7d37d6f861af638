"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct k-word shingles (64-bit hashes of lower-cased
words; a shorter text is one shingle). Shingles are ordered globally: those counted often
last, then by hash. Documents that link must share a shingle in their prefixes, the first
n - ceil(t n) + 1 of each. The steps:

1. One pass counts frequent shingles (each Arrow batch reports those it holds ``LOCAL``
   times or more; summed, at most ``MAX_FREQUENT`` are sent to the workers). The list only
   shapes the order: whatever it holds, no link is lost.
2. One pass stages per document: set size, 128-bit set key, prefix, group key. Documents
   with an identical prefix and size are one group.
3. Group pairs come from a join on prefix shingles, filtered by size and by the positional
   bound on the overlap. First every group meets two hubs of each of its first
   recurring shingles (the group with the fewest shingles of its own, and a random one); verified links are closed to components; then only pairs of groups that lie in
   different components are generated. So thousands of near copies cost one pair each.
4. Group pairs expand to members of distinct sets, which are verified on the full sets,
   stored once in the shared folder and mapped by the verifying tasks.
   Links between members and pairs within a group go the same two rounds.

All-pairs output is never made: the result is (id, n_shingles, component_id), and
``representative pairs`` are the verified links between distinct sets.

Ids are integers; rows that repeat an id are one document, so different texts of it link
all that they link to. Edge cases: texts without words (and nulls) have an empty set, link with nothing and are
their own component; equal sets are one class and always linked; a null id takes no part
in linking and gets a null component; ties cannot arise, as orders end in the hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.sources.scratch import spread

from .arrays import HashArrays, map_array, pack, packed_schema, put_array, unpack
from .common import discard, shared_dir, staged, staged_at
from .graph import connected_components
from .wordhash import grams, lowered, mix, spans, utf8_parts, word_bounds, word_keys

K = 5
HUB_SHINGLES = 12
LOCAL, FREQUENT, MAX_FREQUENT = 4, 24, 1 << 18
BLOCK_BYTES = 1 << 19
U64 = np.uint64


def shingle_sets(column: pa.Array, k: int):
    """Yield the sorted distinct shingle hashes of blocks of rows of a text column, in order: (hashes, where each row starts, and the end)."""
    data, offsets = utf8_parts(column)
    for a, b in spans(offsets, BLOCK_BYTES):
        text, at = lowered(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        start, end = word_bounds(text, at)
        value, ptr = word_keys(text, start, end), np.searchsorted(start, at)
        gram, _, gram_ptr = grams(value, ptr, k)
        bounds = gram_ptr.tolist()
        for i, j in zip(bounds, bounds[1:]):
            gram[i:j].sort()
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        new[gram_ptr[:-1][np.diff(gram_ptr) > 0]] = True
        held = np.concatenate([[0], np.cumsum(new)])[gram_ptr]
        gram, n = gram[new], np.diff(ptr)
        short = np.flatnonzero((n > 0) & (n < k))
        whole = np.zeros(len(short), U64)
        for row, i in enumerate(short.tolist()):  # fewer words than a shingle: all of them are one
            h = 0x2545F4914F6CDD1D + int(n[i])
            for w in value[ptr[i] : ptr[i + 1]].tolist():
                h = (h * 0x9E3779B97F4A7C15 + w) & 0xFFFFFFFFFFFFFFFF
            whole[row] = h
        if len(short):
            gram = np.insert(gram, held[short], mix(whole))
            held = held + np.concatenate([[0], np.cumsum((n > 0) & (n < k))])
        yield gram, held


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of the rows values[ptr[i]:ptr[i+1]]."""
    return np.diff(np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])[ptr])


def frequent_shingles(texts: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of shingles that many documents hold; a bounded hint for the order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = list(shingle_sets(batch.column(0), k))
            flat = np.concatenate([s for s, _ in blocks]) if blocks else np.zeros(0, U64)
            size = np.concatenate([np.diff(ptr) for _, ptr in blocks]) if blocks else np.zeros(0, np.int64)
            first = np.zeros(len(size), bool)
            if len(size):  # copies count once
                marks = np.concatenate([_sums(s, ptr) for s, ptr in blocks]) + size.astype(U64)
                first[np.unique(marks, return_index=True)[1]] = True
            h, c = np.unique(flat[np.repeat(first, size)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[c >= LOCAL].view(np.int64)), pa.array(c[c >= LOCAL])], names=["h", "c"])

    counts = texts.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT)
    top = counts.orderBy(F.col("c").desc(), "h").limit(MAX_FREQUENT).toPandas()["h"].to_numpy(np.int64)
    return np.sort(top.view(U64))


def prefixes(df: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(id, n, k1, k2, g, prefix): size, set key, group key and prefix of every row."""
    texts = df.select(F.col(text_col).alias("text"))
    frequent = df.sparkSession.sparkContext.broadcast(frequent_shingles(texts, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in batches:
            n, k1, k2, g, kept, parts = [], [], [], [], [], []
            for s, ptr in shingle_sets(batch.column(1), k):
                m, row = np.diff(ptr), np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
                n.append(m)
                for to, keys in zip((k1, k2), set_keys(s, ptr)):
                    to.append(keys)
                keep = np.where(m > 0, m + (-percent * m) // 100 + 1, 0)
                place = np.arange(len(s)) - ptr[row]
                if len(often) and len(s):
                    late = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
                    before = np.concatenate([[0], np.cumsum(late)])  # of the late ones
                    nth = before[:-1] - before[ptr[:-1]][row]
                    place = np.where(late, (m - np.diff(before[ptr]))[row] + nth, place - nth)
                to = np.concatenate([[0], np.cumsum(keep)])
                ours = place < keep[row]
                prefix = np.zeros(to[-1], U64)
                prefix[(to[:-1][row] + place)[ours]] = s[ours]
                g.append(mix(_sums(mix(prefix * U64(3)), to) ^ m.astype(U64) * U64(0x9E3779B97F4A7C15)))
                kept.append(keep)
                parts.append(prefix)
            joined = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            at = np.concatenate([[0], np.cumsum(joined(kept, np.int64))]).astype(np.int32)
            flat = joined(parts, U64).view(np.int64)
            signed = [pa.array(joined(x, U64).view(np.int64)) for x in (k1, k2, g)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(joined(n, np.int64)), *signed, pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["id", "n", "k1", "k2", "g", "prefix"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, k1 long, k2 long, g long, prefix array<bigint>")


def _similar_sizes(x: Column, y: Column, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _needed(x: Column, y: Column, percent: int) -> Column:
    """Least overlap of two sets of these sizes that link."""
    return F.ceil(percent * (x + y) / (100 + percent) - 1e-9)


def _group_pairs(left: DataFrame, right: DataFrame, condition: Column, percent: int) -> DataFrame:
    """Distinct pairs (ga, gb) of groups sharing a prefix shingle that size and position allow."""
    a, b = left.alias("a"), right.alias("b")
    # what comes before a shared shingle can only be shared where it recurs too
    most = F.least("a.nth", "b.nth") + 1 + F.least(F.col("a.n") - F.col("a.pos") - 1, F.col("b.n") - F.col("b.pos") - 1)
    fits = _similar_sizes(F.col("a.n"), F.col("b.n"), percent) & (most >= _needed(F.col("a.n"), F.col("b.n"), percent))
    both = a.join(b, F.col("a.t") == F.col("b.t")).where(condition & fits)
    flip = F.col("a.g") > F.col("b.g")  # a pair counts under one name, whichever side a list has it on
    low = lambda c: F.when(flip, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    high = lambda c: F.when(flip, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    names = (("g", "ga", "gb"), ("n", "na", "nb"), ("pos", "pa", "pb"))
    both = both.select("a.t", *[x for c, a_, b_ in names for x in (low(c).alias(a_), high(c).alias(b_))])
    both = both.groupBy("ga", "gb", "na", "nb").agg(F.count("*").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    most = F.col("c") + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)
    return both.where(most >= _needed(F.col("na"), F.col("nb"), percent)).select("ga", "gb")


def _first_rows(rows: DataFrame) -> HashArrays:
    """The smallest row number of every group: one row that stands for it."""
    out = HashArrays.named(rows, "groups", {"row": "int64"})

    def least(key: np.ndarray, row: np.ndarray):
        order = np.lexsort((row, key))
        key, row = key[order], row[order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        return key[first], row[first]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, row = least(np.asarray(batch.column(0), np.int64).view(U64), np.asarray(batch.column(1), np.int64))
            yield pack(key, [row], out.n_shards)

    def merge(table: pa.Table):
        key, row = least(*unpack(table, [U64, np.int64]))
        return key, {"row": row}

    out.fill(rows.select("g", "row").mapInArrow(send, packed_schema(2)), merge)
    return out


def _standing(batch: pa.RecordBatch, groups: HashArrays) -> pa.RecordBatch:
    """The rows (g, row, ...) of a batch that stand for their group."""
    _, got = groups.lookup(np.asarray(batch.column(0), np.int64).view(U64))
    return batch.filter(pa.array(got["row"] == np.asarray(batch.column(1), np.int64)))


def _postings(rows: DataFrame) -> tuple[DataFrame, str]:
    """(g, n, pos, t, nth) of every group and prefix shingle that another group's prefix has too, and its folder.

    nth numbers the recurring shingles of a group from 0 in prefix order.
    """
    groups = _first_rows(rows)
    wide = rows.select("g", "row", "n", "prefix")
    recurring = HashArrays.named(rows, "prefix-shingles", {})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(_standing(batch, groups).column(3).flatten(), np.int64)
            key, count = np.unique(flat.view(U64), return_counts=True)
            yield pack(key, [np.minimum(count, 2).astype(np.uint8)], recurring.n_shards)

    def merge(table: pa.Table):
        key, count = unpack(table, [U64, np.uint8])
        order = np.argsort(key)
        key, count = key[order], count[order].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return (key[start][np.add.reduceat(count, start) > 1] if len(start) else key), {}

    recurring.fill(wide.mapInArrow(send, packed_schema(2)), merge)
    discard(rows.sparkSession)  # the shuffle of all prefixes, before that of the postings

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _standing(batch, groups)
            lists = batch.column(3)
            flat, size = np.asarray(lists.flatten(), np.int64), np.asarray(lists.value_lengths(), np.int64)
            row, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
            hit, _ = recurring.lookup(flat.view(U64))
            seen = np.concatenate([[0], np.cumsum(hit)])
            pos, nth = np.arange(len(flat)) - start[row], seen[:-1] - seen[start][row] if len(flat) else seen[:0]
            at = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(pos[hit]), pa.array(flat[hit]), pa.array(nth[hit])], names=["g", "n", "pos", "t", "nth"])

    out = staged_at(wide.mapInArrow(post, "g long, n long, pos long, t long, nth long"), "postings")
    discard(rows.sparkSession, recurring.base, groups.base)
    return out


def _spread(posts: DataFrame, label: DataFrame) -> tuple[DataFrame, str]:
    """The postings of shingles that join groups of different components, with the groups' least and largest component, and their folder.

    ``main``: whether all of the group is in the least component of the shingle's list; in a
    list of many near copies, most are.
    """
    comps = HashArrays.named(posts, "group-components", {"lo": "int64", "hi": "int64"})
    split = HashArrays.named(posts, "spread-shingles", {"lo": "int64"})

    def fold(key, lo, hi):
        order = np.argsort(key)
        key, lo, hi = key[order], lo[order], hi[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return (key[start], np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start)) if len(start) else (key, lo, hi)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, lo, hi = fold(np.asarray(batch.column(0), np.int64).view(U64), *(np.asarray(batch.column(1), np.int64),) * 2)
            yield pack(key, [lo, hi], comps.n_shards)

    def merge(table: pa.Table):
        key, lo, hi = fold(*unpack(table, [U64, np.int64, np.int64]))
        return key, {"lo": lo, "hi": hi}

    comps.fill(label.select("g", F.col("comp").cast("long")).mapInArrow(send, packed_schema(3)), merge)

    def send_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, got = comps.lookup(np.asarray(batch.column(0), np.int64).view(U64))
            key, lo, hi = fold(np.asarray(batch.column(3), np.int64).view(U64), got["lo"], got["hi"])
            yield pack(key, [lo, hi], split.n_shards)

    def keep_split(table: pa.Table):
        key, lo, hi = fold(*unpack(table, [U64, np.int64, np.int64]))
        return key[lo != hi], {"lo": lo[lo != hi]}

    split.fill(posts.mapInArrow(send_lists, packed_schema(3)), keep_split)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, of_list = split.lookup(np.asarray(batch.column(3), np.int64).view(U64))
            batch = batch.filter(pa.array(hit))
            _, got = comps.lookup(np.asarray(batch.column(0), np.int64).view(U64))
            main = (got["lo"] == of_list["lo"][hit]) & (got["hi"] == got["lo"])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(got["lo"]), pa.array(got["hi"]), pa.array(main)], names=["g", "n", "pos", "t", "nth", "lo", "hi", "main"])

    out = staged_at(posts.mapInArrow(mark, "g long, n long, pos long, t long, nth long, lo long, hi long, main boolean"), "spread")
    discard(posts.sparkSession, comps.base, split.base)
    return out


def set_keys(s: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every set of shingles s[ptr[i]:ptr[i+1]]."""
    return _sums(s, ptr), _sums(mix(s ^ U64(0xA5A5A5A5A5A5A5A5)), ptr)


def _stored_sets(docs: DataFrame, wanted: DataFrame, k: int) -> tuple[DataFrame, str]:
    """(sid, file, start, size): where the sets of the wanted documents (id) lie, by number of the set, and the folder of all.

    Tasks write the sets of a block as one array and return its index; a task that is
    repeated writes another file, and only the index that counts names one. Texts that are
    not wanted are passed by in place, so no text is shuffled.
    """
    keys = HashArrays.named(docs, "wanted", {})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pack(np.unique(np.asarray(batch.column(0), dtype=np.int64).view(U64)), [], keys.n_shards)

    keys.fill(wanted.select(F.xxhash64("id").alias("h")).mapInArrow(send, packed_schema(1)), lambda table: (np.unique(unpack(table, [U64])[0]), {}))
    base = f"{shared_dir(docs.sparkSession)}/lapforge/sets-{uuid.uuid4().hex}"

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, _ = keys.lookup(np.asarray(batch.column(1), dtype=np.int64).view(U64))
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            sets = list(shingle_sets(batch.column(2).take(pa.array(at)), k))
            size = np.concatenate([np.diff(ptr) for _, ptr in sets])
            put_array(name := f"{base}/{uuid.uuid4().hex}", np.concatenate([s for s, _ in sets]))
            k1, k2 = (np.concatenate(x).view(np.int64) for x in zip(*(set_keys(s, ptr) for s, ptr in sets)))
            cols = [pa.array(k1), pa.array(k2), pa.array([name] * len(at)), pa.array(np.cumsum(size) - size), pa.array(size)]
            yield pa.RecordBatch.from_arrays(cols, names=["k1", "k2", "file", "start", "size"])

    index = docs.select("id", F.xxhash64("id").alias("h"), "text").mapInArrow(store, "k1 long, k2 long, file string, start long, size long")
    index = index.where("size > 0").select(F.xxhash64("k1", "k2", F.col("size")).alias("sid"), "file", "start", "size")
    sets = staged(index.dropDuplicates(["sid"]), "sets")
    discard(docs.sparkSession, keys.base)
    return sets, base


def _verify(pairs: DataFrame, members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the staged pairs (a, b) of set numbers whose full sets link; ``members`` names a document of each set (sid, rep)."""
    if pairs.isEmpty():
        return pairs
    discard(docs.sparkSession)  # the shuffles that found the pairs, before the sets are stored
    asked = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    sets, folder = _stored_sets(docs, members.join(asked, "sid", "left_semi").select(F.col("rep").alias("id")).distinct(), k)

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, np.ndarray] = {}

        def get(file: str, start: int, size: int) -> np.ndarray:
            if file not in files:
                if len(files) > 256:
                    files.clear()
                files[file] = map_array(file, U64)
            return files[file][start : start + size]

        for batch in batches:
            ok = []
            for fa, sa, na, fb, sb, nb in zip(*(batch.column(i).to_pylist() for i in range(2, 8))):
                same = len(np.intersect1d(get(fa, sa, na), get(fb, sb, nb), assume_unique=True))
                ok.append(100 * same >= percent * (na + nb - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda x: sets.select(F.col("sid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("file", "start", "size")])
    placed = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{c}_{x}" for x in "ab" for c in ("file", "start", "size")])
    placed = spread(placed, "a", "b")  # few bytes a pair and two whole sets to read, so tasks of adaptive size would hold too many
    out = staged(placed.mapInArrow(overlap, "a long, b long"), "links")
    discard(docs.sparkSession, folder)
    return out


def link_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = 75) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, links, components): documents with size and set key, the verified links between numbers of distinct sets that closed the components, and the components."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held, prefixes_at = staged_at(prefixes(df, id_col, text_col, k, percent).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    real = held.where("n > 0 and id is not null")
    members = staged(real.groupBy("k1", "k2", "n", "g").agg(F.min("id").alias("rep")).withColumn("sid", F.xxhash64("k1", "k2", "n")), "members")
    posts, posts_at = _postings(real)
    # what follows asks for sizes and keys alone, so the prefixes go
    rows = staged(held.select("id", "n", "k1", "k2"), "rows")
    real = rows.where("n > 0 and id is not null")
    discard(df.sparkSession, prefixes_at)

    # round one: hubs of the first few recurring shingles of each group. Bands of size keep hubs comparable. One hub
    # has the fewest shingles of its own before, so of many edited copies it is the one nearest to what they were made
    # from; the other is a random one, so that copies which the first misses meet many others.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)))
    early = posts.where(F.col("nth") < HUB_SHINGLES)
    near, any_ = (F.min(F.struct(by.alias("by"), "g", "n", "pos", "nth")) for by in (F.col("pos") - F.col("nth"), F.xxhash64("g", "t")))
    lists = early.groupBy("t", band.alias("band")).agg(F.array(near, any_).alias("hubs"), F.count("*").alias("m")).where("m > 1")
    hubs = lists.select("t", F.explode(F.array_distinct(F.transform("hubs", lambda h: h.dropFields("by")))).alias("hub")).select("t", "hub.*")
    star = _group_pairs(early, hubs, F.col("a.g") != F.col("b.g"), percent)
    least = members.groupBy("g").agg(F.min("sid").alias("head"), F.count("*").alias("m"))
    heads = least.select("g", "head")
    pairs = star.join(heads.select(F.col("g").alias("ga"), F.col("head").alias("a")), "ga").join(heads.select(F.col("g").alias("gb"), F.col("head").alias("b")), "gb").select("a", "b")
    inside = members.join(least.where("m > 1"), "g").where("sid <> head").select(F.col("sid").alias("a"), F.col("head").alias("b"))
    done = staged(_normal(pairs.unionByName(inside)), "candidates")
    first = _verify(done, members, docs, k, percent)
    labels = staged(connected_components(first), "components")

    # round two: all pairs of members that are not connected yet
    label = members.join(labels, F.col("sid") == F.col("node"), "left").select("g", "n", "sid", F.coalesce("component", "sid").alias("comp"))
    label = staged(label, "labels")
    of_group = label.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    marked, marked_at = _spread(posts, label)
    discard(df.sparkSession, posts_at)
    # two groups of a list's main component need no look, so the main ones are on one side of the join alone
    apart = ~F.col("a.main") & (F.col("b.main") | (F.col("a.g") < F.col("b.g"))) & ((F.col("a.lo") != F.col("b.lo")) | (F.col("a.hi") != F.col("b.hi")) | (F.col("a.lo") != F.col("a.hi")))
    rest = _group_pairs(marked, marked, apart, percent)
    side = lambda g, x: label.select(F.col("g").alias(g), F.col("sid").alias(x), F.col("comp").alias(f"{x}_comp"))
    rest = rest.join(side("ga", "a"), "ga").join(side("gb", "b"), "gb").where("a_comp <> b_comp").select("a", "b")
    mixed = label.join(of_group.where("lo <> hi").select("g"), "g", "left_semi")
    within = mixed.alias("x").join(mixed.alias("y"), F.col("x.g") == F.col("y.g")).where("x.sid < y.sid and x.comp <> y.comp").select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))
    asked = staged(_normal(rest.unionByName(within)).join(done, ["a", "b"], "left_anti"), "candidates")
    discard(df.sparkSession, marked_at)
    second = _verify(asked, members, docs, k, percent)
    links = first.unionByName(second)
    # rows of one id are one document, whatever their texts: their sets are in one component
    sets_of = real.select("id", F.xxhash64("k1", "k2", "n").alias("sid")).groupBy("id", "sid").count()
    twice = sets_of.groupBy("id").agg(F.min("sid").alias("least"), F.count("*").alias("m")).where("m > 1")
    same_id = sets_of.join(twice, "id").where("sid <> least").select(F.col("sid").alias("a"), F.col("least").alias("b"))
    final = connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second).unionByName(same_id))
    label = staged(members.join(final, F.col("sid") == F.col("node"), "left").select("k1", "k2", "n", "rep", F.coalesce("component", "sid").alias("comp")), "final")
    least = label.groupBy("comp").agg(F.min("rep").alias("component_id"))
    comps = label.join(least, "comp").select("k1", "k2", "n", "component_id")
    return rows.select("id", "n", "k1", "k2"), links, comps


def _normal(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    rows, _, comps = link_classes(df, id_col, text_col, k, percent)
    many = comps.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("n").alias("_n"), "component_id")
    out = rows.join(many, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & (F.col("n") == F.col("_n")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
