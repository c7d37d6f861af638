"""Texts cut into items that repeat (lines, pre-tokens), each distinct item being computed once.

``factor`` writes one row for each Arrow batch of rows (a block, some megabytes of text):
the distinct items of the block, and packed postings: which items every row of it holds and how
often. Each item leaves its block once; what is computed for it comes back as (block, nth item, values)
and ``sums`` joins that to the postings of the block and adds it up row by row.

Scale: an item leaves a block once, however many rows repeat it, so even one that all rows
hold has a key of one row a block; no key of the joins outgrows the number of blocks, and
nothing needs salting. Postings travel once, by block. A block is bounded by the batch
size of the session, but a row longer than that is a block of its own.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, staged

#: (items, number of postings of each row, item of each posting, its count, further arrays of whole numbers)
Split = Callable[[pa.Array], tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]
HELD = 1 << 18  # items whose values a task holds back to send those of a block together


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers of up to 32 bits, compressed by byte planes."""
    raw = b"".join(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays)
    head = struct.pack(f"<{len(arrays) + 1}q", len(arrays), *map(len, arrays))
    return head + pa.compress(raw, codec="zstd", asbytes=True) if raw else head


def unpack(data: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<q", data)
    sizes = struct.unpack_from(f"<{n}q", data, 8)
    out, at = [], 0
    raw = np.frombuffer(pa.decompress(data[8 * (n + 1) :], decompressed_size=4 * sum(sizes), codec="zstd") if sum(sizes) else b"", np.uint8)
    for size in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 4 * size].reshape(4, size).T).view("<u4").ravel().astype(np.int64))
        at += 4 * size
    return out


def postings(row: np.ndarray, item: np.ndarray, n: np.ndarray, n_rows: int, n_items: int):
    """(number of postings a row, item, count) of (row, item, count) triples in any order, equal pairs added up, items in order."""
    pair, inverse = np.unique(row.astype(np.int64) * max(n_items, 1) + item, return_inverse=True)
    count = np.bincount(inverse, weights=n, minlength=len(pair)).astype(np.int64)  # exact below 2**53
    return np.bincount(pair // max(n_items, 1), minlength=n_rows), pair % max(n_items, 1), count


def _steps(size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Items of each row as differences from the one before; the first of a row stays itself."""
    out = np.diff(at, prepend=0)
    first = (np.cumsum(size) - size)[size > 0]
    out[first] = at[first]
    return out


def _unstep(size: np.ndarray, steps: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(steps)])
    return upto[1:] - np.repeat(upto[np.cumsum(size) - size], size)


def factor(df: DataFrame, text: Column, keep: list[Column], split: Split, item_type: T.DataType, occurs: bool = False, label: str = "blocks") -> DataFrame:
    """The staged block rows of ``df``: block, items (with their occurrences), postings and the kept columns as lists."""
    bounded_batches(df.sparkSession)
    held, n_keep = df.select(text.alias("text"), *[c.alias(f"keep_{i}") for i, c in enumerate(keep)]), len(keep)
    item_arrow = pa.binary() if isinstance(item_type, T.BinaryType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            items, size, at, n, more = split(batch.column(0))
            whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [pa.array([block]), whole(items.cast(item_arrow))]
            if occurs:
                columns.append(whole(pa.array(np.bincount(at, weights=n, minlength=len(items)).astype(np.int64))))
            columns += [pa.array([pack(size, _steps(size, at), n, *more)], pa.binary()), *[whole(batch.column(i + 1)) for i in range(n_keep)]]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            block += 1

    fields = [("block", T.LongType()), ("items", T.ArrayType(item_type)), *([("occurs", T.ArrayType(T.LongType()))] if occurs else []), ("postings", T.BinaryType())]
    fields += [(f"keep_{i}", T.ArrayType(held.schema[i + 1].dataType)) for i in range(n_keep)]
    names = [f[0] for f in fields]
    return staged(held.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields])), label)


def distinct(blocks: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """(key, occurs, item) of every distinct item of the whole table."""
    each = blocks.select(F.explode(F.arrays_zip("items", "occurs")).alias("e")).select(key(F.col("e.items")).alias("key"), F.col("e.occurs").alias("occurs"), F.col("e.items").alias("item"))
    return each.groupBy("key").agg(F.sum("occurs").alias("occurs"), F.first("item").alias("item"))


def joined_back(blocks: DataFrame, values: DataFrame, names: list[str], key: Callable[[Column], Column]) -> DataFrame:
    """(block, nth, names...): ``values`` (key, names...) joined to the items of the blocks."""
    items = blocks.select("block", F.posexplode("items").alias("nth", "item")).select("block", "nth", key(F.col("item")).alias("key"))
    return items.join(values.select("key", *names), "key").select("block", "nth", *names)


def counted_back(blocks: DataFrame, count: Callable[[list], list[int]]) -> DataFrame:
    """(block, packed): one number for every item, sorted together so that each distinct item is counted once."""
    items = blocks.select("block", F.posexplode("items").alias("nth", "item"))

    def sent(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        block, nth, n = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((nth, block))
        block, nth, n = block[order], nth[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        packed = [pack(np.diff(nth[a:b], prepend=0), n[a:b]) for a, b in zip(first, [*first[1:], len(block)])]
        return pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(packed, pa.binary())], names=["block", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, last, last_n = [], 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            item = batch.column(2)
            new = np.concatenate([[item[0].as_py() != last], ~np.asarray(pc.equal(item[1:], item[:-1]), dtype=bool)])
            fresh = item.take(pa.array(np.flatnonzero(new))).to_pylist()
            n = np.array([last_n, *count(fresh)], np.int64)[np.cumsum(new)]
            last, last_n = item[batch.num_rows - 1].as_py(), int(n[-1])
            parts.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.int64), n))
            held += batch.num_rows
            if held >= HELD:
                yield sent(parts)
                parts, held = [], 0
        if parts:
            yield sent(parts)

    together = items.repartition("item").sortWithinPartitions("item")
    return together.mapInArrow(run, "block long, packed binary")


def sums(blocks: DataFrame, back: DataFrame, keep: list[T.StructField], names: list[str], more: Callable[[list[np.ndarray]], dict[str, np.ndarray]] | None = None) -> DataFrame:
    """The kept columns of every row, and the sum over its items of each named value (long) that came back.

    ``more`` turns the further arrays of a block into what they add to named sums, one number a row.
    """
    rows = blocks.select(F.col("block").alias("of"), "postings", *[f"keep_{i}" for i in range(len(keep))])
    schema = T.StructType([*keep, *[T.StructField(n, T.LongType()) for n in names]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        flat = lambda name: pa.concat_arrays([chunk.flatten() for chunk in right.column(name).chunks])
        size, steps, n, *further = unpack(right.column("postings")[0].as_py())
        at = _unstep(size, steps)
        if "packed" in left.column_names:
            parts = [unpack(x) for x in left.column("packed").to_pylist()]
            nth = np.concatenate([np.cumsum(p[0]) for p in parts] or [at[:0]])
            values = {names[0]: np.concatenate([p[1] for p in parts] or [at[:0]])}
        else:
            nth, values = np.asarray(left.column("nth")), {c: np.asarray(left.column(c)).astype(np.int64) for c in names}
        order = np.argsort(nth)
        ends = np.cumsum(size)
        out = {}
        for c in names:
            upto = np.concatenate([[0], np.cumsum(values[c][order][at] * n)])
            out[c] = upto[ends] - upto[ends - size]
        for c, extra in (more(further) if more else {}).items():
            out[c] = out[c] + extra
        return pa.table([*[flat(f"keep_{i}") for i in range(len(keep))], *[pa.array(out[c], pa.int64()) for c in names]], names=schema.names)

    return back.groupBy("block").cogroup(rows.groupBy("of")).applyInArrow(run, schema)
