"""Suffix-array dedup: removal of byte strings that an earlier document holds too.

A string of ``length`` bytes has one anchor, the leftmost of its least (by hash)
``GRAM``-byte grams, so equal strings have equal anchors. Consecutive strings with the same
anchor make one unit, and every string lies in exactly one.

1. Anchors found in two or more documents are recurring (one pass, hashes only).
2. Every unit of a recurring anchor is sent with its bytes to the shard of its anchor; equal
   units of a block are sent once. An anchor of over ``HOT`` documents is no shard key: its
   strings are units of their own, dealt by their whole content.
3. A shard folds equal units (least and last document), builds the Burrows-Wheeler transform
   of each source of about ``SOURCE_BYTES`` bytes on its own, and merges the transforms by
   interleave refinement: each round prepends one symbol to every live rank, through the
   last-to-first map of its source, and a stable pass by symbol splits the intervals. Equal
   strings have their anchor at the same place, which gives the first intervals. An interval
   that is down to one unit is settled; after ``length`` rounds what is left are the
   intervals of strings found in several units. Nothing is sorted again.
   Every interval says which of its strings start in a smaller document; the shard writes
   that, and nothing is removed without it.
4. A last pass over the texts looks units up and removes the covered bytes.

The tables are sorted hash arrays mapped by the workers; a unit is found by a 64-bit hash of
its bytes together with the 64-bit hash of its anchor. Shards are as many as the text's bytes ask for.

Ids are integers. Edge cases: a null or empty text keeps nothing and loses nothing; texts
shorter than ``length`` lose nothing; rows that repeat an id are the same document, so they
don't erase one another, whether their texts are equal or not; a null id is the last
document. Columns to carry may have any name; those of computed columns are replaced. Bytes
that removal leaves need not be whole UTF-8 characters. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import HashArrays, held_starts, pack, packed_schema, ranges, reduced, run_starts, sliding_min, unpack
from .common import shards_for
from .wordhash import mix, powers_down, prefix_hash, span_hash, spans, utf8_parts

LENGTH, GRAM, HOT = 50, 20, 4096
BLOCK_BYTES, SOURCE_BYTES, SHARD_BYTES = 1 << 21, 1 << 20, 8 << 20
LAST = np.iinfo(np.int64).max
U64 = np.uint64


class Block:
    """Anchors and units of consecutive rows of one batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, length: int):
        self.data, self.offsets, self.ids, self.length = data, offsets, ids, length
        gram = min(GRAM, length)
        self.total = prefix_hash(data)
        self.low = self.high = self.at = np.zeros(0, np.int64)  # a unit is all strings that start in [low, high)
        if len(data) >= length:
            self._cut(gram)
        self.row = np.searchsorted(offsets, self.at, "right") - 1
        self.doc = ids[self.row]
        self.anchor = mix(span_hash(self.total, self.at, self.at + gram))

    def _cut(self, gram: int) -> None:
        n, width = len(self.data) - gram + 1, self.length - gram + 1
        value = self.total[gram:] - self.total[:n]
        value *= powers_down(n)
        value ^= value >> U64(32)
        value *= U64(0xD6E8FEB86659FD93)
        order = (value >> U64(32)).astype(np.uint32)  # half the width compares twice as fast
        order |= np.uint32(1)
        low = sliding_min(order, width)
        for o in self.offsets[1:-1]:
            low[max(0, o - self.length + 1) : o] = 0  # strings across rows are none
        edge = np.zeros(width - 1, np.uint32)
        top = ~sliding_min(~np.concatenate([edge, low, edge]), width)
        at = np.flatnonzero(order == top)
        if not len(at):
            return
        row = np.searchsorted(self.offsets, at, "right") - 1
        first, last = held_starts(order, at, width, self.offsets[row], self.offsets[row + 1] - self.length)
        used = first <= last
        self.at, self.low, self.high = at[used], first[used], last[used] + 1

    def recur(self, anchors: HashArrays) -> None:
        """Keep the units of recurring anchors; those of hot anchors fall into single strings."""
        hit, got = anchors.lookup(self.anchor)
        hot = got["hot"] > 0
        parts = [(self.low[x], self.high[x], self.at[x], self.anchor[x], self.doc[x]) for x in (hit & ~hot,)]
        many = np.flatnonzero(hit & hot)
        if len(many):
            size = self.high[many] - self.low[many]
            each, start = np.repeat(many, size), ranges(self.low[many], size)
            parts.append((start, start + 1, self.at[each], self.anchor[each], self.doc[each]))
        self.low, self.high, self.at, self.anchor, self.doc = (np.concatenate(x) for x in zip(*parts))
        alone = np.arange(len(self.low)) >= len(self.low) - (len(parts[-1][0]) if len(many) else 0)
        size = self.high - self.low + self.length - 1
        shape = (self.at - self.low).astype(U64) * U64(4096) + size.astype(U64)
        self.size, self.key = size, mix(span_hash(self.total, self.low, self.low + size) ^ mix(shape))
        self.deal = np.where(alone, mix(self.key), self.anchor)


def blocks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[Block, int, int]]:
    ids = np.asarray(batch.column(0).cast(pa.int64()).fill_null(LAST))
    data, offsets = utf8_parts(batch.column(1))
    for a, b in spans(offsets, BLOCK_BYTES):
        yield Block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ids[a:b], length), a, b


def _recurring(texts: DataFrame, length: int, n_shards: int) -> HashArrays:
    anchors = HashArrays.named(texts, "anchors", {"hot": "uint8"}, n_shards)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *_ in blocks(batch, length):
                order = np.argsort(block.anchor, kind="stable")
                key, row = block.anchor[order], block.row[order]
                one = run_starts(key, row)
                start = run_starts(key[one])
                count = np.diff(np.append(start, len(one)))
                yield pack(key[one][start], [np.minimum(count, HOT + 1).astype(np.uint16)], n_shards)

    def merge(rows: pa.Table):
        key, count = unpack(rows, [U64, np.uint16])
        order = np.argsort(key, kind="stable")
        start = run_starts(key[order])
        count = reduced(np.add, count[order].astype(np.int64), start)
        return key[order][start][count > 1], {"hot": count[count > 1] > HOT}

    anchors.fill(texts.mapInArrow(send, packed_schema(2)), merge)
    return anchors


def shard_bwt(data: np.ndarray, size: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of a set of strings: (symbols, last-to-first map, string, offset), in suffix order.

    Each string ends in a mark that sorts before all bytes. Suffixes are sorted by ``depth``
    symbols at least, equal ones in no certain order. The symbol of a whole string is 0; its map is its own rank.
    """
    n = len(data) + len(size)
    string = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
    offset = (np.arange(n) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)).astype(np.int32)
    left = np.repeat(size, size + 1) - offset
    inside = left > 0
    padded = np.zeros(n + 6 * len(size) + 6, np.uint64)  # seven end marks a string, so that no key reaches into the next
    at = np.arange(n) + np.int64(6) * string
    padded[at[inside]] = data
    padded[at[inside]] += U64(1)
    key = padded[: len(padded) - 6].copy()
    for i in range(1, 7):  # seven symbols of nine bits
        key <<= U64(9)
        key |= padded[i : len(padded) - 6 + i]
    key, text, width = key[at], padded[at].astype(np.int16), 7
    order = np.argsort(key)
    start = run_starts(key[order])
    rank = np.empty(n, np.int32)
    count = np.diff(np.append(start, n))
    rank[order] = np.repeat(start, count)
    tied = order[np.repeat(count > 1, count)]
    while width < depth:
        tied = tied[left[tied] >= width]  # shorter ones that tie are equal
        if not len(tied):
            break
        tie = (rank[tied].astype(U64) << U64(32)) | rank[tied + width].astype(U64)
        by = np.argsort(tie)
        tied, tie = tied[by], tie[by]
        group, start = run_starts(rank[tied]), run_starts(tie)
        nth = np.arange(len(tied)) - np.repeat(group, np.diff(np.append(group, len(tied))))
        order[rank[tied] + nth] = tied
        fresh = rank[tied] + nth
        count = np.diff(np.append(start, len(tied)))
        rank[tied] = np.repeat(fresh[start], count)
        tied = tied[np.repeat(count > 1, count)]
        width *= 2
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    offset = offset[order]
    before = order - (offset > 0)
    symbol = np.where(offset > 0, text[before] - 1, 0).astype(np.uint8)
    return symbol, place[before], string[order], offset


def merge_bwts(symbol: np.ndarray, back: np.ndarray, rank: np.ndarray, interval: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Refine the interleave of several transforms by ``depth`` symbols.

    ``symbol`` and ``back`` hold the transforms one after the other. ``rank`` are the places
    of the suffixes that end each string to compare, ordered by their first ``interval``. A
    round prepends one symbol to all live ranks and so splits their intervals.

    Returns (ranks, intervals) of the strings found more than once, and (ranks, symbols still
    to prepend) of those whose interval came down to themselves.
    """
    alone, steps = [], []
    for i in range(depth + 1):
        start = run_starts(interval)
        count = np.diff(np.append(start, len(interval)))
        live = np.repeat(count > 1, count)
        alone.append(rank[~live])
        steps.append(np.full(len(alone[-1]), depth - i, np.int64))
        rank = rank[live]
        interval = np.repeat(np.arange(len(start), dtype=np.int32), count)[live]
        if i == depth or not len(rank):
            break
        first = symbol[rank]
        order = np.argsort(first, kind="stable")
        first, rank, interval = first[order], back[rank[order]], interval[order]
        start = run_starts(first, interval)
        interval = np.repeat(np.arange(len(start), dtype=np.int32), np.diff(np.append(start, len(rank))))
    return rank, interval, np.concatenate(alone), np.concatenate(steps)


def _repeats(texts: DataFrame, anchors: HashArrays, length: int, n_shards: int) -> HashArrays:
    """For each unit with a string found in two documents: its least document, and a bit for each string
    that a smaller one than this holds (``mask``), or than any later one that holds the unit (``again``)."""
    units = HashArrays.named(texts, "units", {"anchor": "uint64", "doc": "int64", "again": "uint64", "mask": "uint64"}, n_shards)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *_ in blocks(batch, length):
                block.recur(anchors)
                shard = (block.deal % U64(n_shards)).astype(np.int64)
                order = np.lexsort((block.doc, block.key, block.anchor, shard))
                start = run_starts(block.key[order], block.anchor[order], shard[order])
                one, last = order[start], order[np.append(start[1:], len(order)) - 1] if len(start) else order
                shard = shard[one]
                cut = np.searchsorted(shard, np.arange(n_shards + 1))
                used = np.flatnonzero(np.diff(cut))
                cols = (block.key[one], block.anchor[one], block.doc[one], block.doc[last], block.size[one].astype(np.uint16), (block.at - block.low)[one].astype(np.uint8))
                rows = [[c[cut[s] : cut[s + 1]].tobytes() for s in used] for c in cols]
                rows.append([block.data[ranges(block.low[one[cut[s] : cut[s + 1]]], block.size[one[cut[s] : cut[s + 1]]])].tobytes() for s in used])
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32())] + [pa.array(r, pa.binary()) for r in rows], names=["shard", *[f"b{i}" for i in range(7)]])

    def merge(rows: pa.Table):
        kinds = [U64, U64, np.int64, np.int64, np.uint16, np.uint8, np.uint8]
        key, anchor, doc, last, size, reach, data = unpack(rows, kinds)
        size = size.astype(np.int64)
        low = np.cumsum(size) - size
        order = np.lexsort((doc, key, anchor))
        start = run_starts(key[order], anchor[order])
        one = np.sort(order[start])  # in the order of arrival: each source is some blocks of the input
        doc[order[start]], last[order[start]] = reduced(np.minimum, doc[order], start), reduced(np.maximum, last[order], start)
        key, anchor, doc, last, size, reach, low = (x[one] for x in (key, anchor, doc, last, size, reach, low))
        parts, base = [[], [], [], []], 0
        where = np.zeros(int((size + 1).sum()), np.int32)  # rank of each suffix, by unit and offset
        first = np.cumsum(size + 1) - size - 1
        for a, b in spans(np.concatenate([[0], np.cumsum(size)]), SOURCE_BYTES):
            symbol, back, string, offset = shard_bwt(data[ranges(low[a:b], size[a:b])], size[a:b], length)
            for part, x in zip(parts, (symbol, back + np.int32(base), string + np.int32(a), offset.astype(np.uint8 if size.max() < 256 else np.uint16))):
                part.append(x)
            where[first[string + a] + offset] = np.arange(base, base + len(symbol))
            base += len(symbol)
        symbol, back, string, offset = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
        n = size - length + 1
        unit = np.repeat(np.arange(len(n)), n)
        start = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
        place = reach[unit].astype(np.int64) - start  # of the anchor in the string
        order = np.lexsort((place, anchor[unit]))
        unit, start, place = unit[order], start[order], place[order]
        seed = np.cumsum(np.bincount(run_starts(anchor[unit], place), minlength=len(unit)))[: len(unit)]
        rank, interval, alone, steps = merge_bwts(symbol, back, where[first[unit] + start + length], seed, length)
        ptr = np.cumsum(n) - n
        again, later = np.zeros(len(unit), bool), np.zeros(len(unit), bool)  # of every string
        of = string[alone]
        again[ptr[of] + offset[alone] - steps] = last[of] > doc[of]
        begin = run_starts(interval)
        count = np.diff(np.append(begin, len(rank)))
        of = string[rank]
        least = np.repeat(reduced(np.minimum, doc[of], begin), count)
        again[ptr[of] + offset[rank]] = last[of] > least
        later[ptr[of] + offset[rank]] = doc[of] > least
        bit = U64(1) << (np.arange(len(unit)) - np.repeat(ptr, n)).astype(U64)
        again, mask = (reduced(np.add, np.where(x, bit, U64(0)), ptr) for x in (again, later))
        found = (again | mask) > 0
        return key[found], {"anchor": anchor[found], "doc": doc[found], "again": again[found], "mask": mask[found]}

    units.fill(texts.mapInArrow(send, packed_schema(7)), merge)
    return units


def covered(block: Block, anchors: HashArrays, units: HashArrays) -> np.ndarray:
    """Whether each byte of the block lies in a string that a smaller document holds."""
    block.recur(anchors)
    hit, got = units.lookup(block.key, block.deal)
    hit &= got["anchor"] == block.anchor
    bits = np.where(hit, np.where(got["doc"] < block.doc, got["again"], got["mask"]), U64(0))
    begins = np.zeros(len(block.data) + 1, np.int32)
    n = block.high - block.low
    whole = (n > 0) & (bits == (U64(1) << n.astype(U64)) - U64(1))
    begins[block.low[whole]] += 1
    begins[block.high[whole]] -= 1
    begins = np.cumsum(begins)
    some = np.flatnonzero((bits > 0) & ~whole)
    for t in range(int(n[some].max(initial=0))):
        begins[block.low[some[(bits[some] >> U64(t)) & U64(1) > 0]] + t] = 1
    total = np.concatenate([np.zeros(block.length, np.int64), np.cumsum(begins[:-1])])
    return total[block.length :] > total[: -block.length]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, out_col: str = "kept", digest: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept bytes or their SHA-256, columns to carry) of every row.

    ``length`` is at most 64. A carried column of the name of a computed one is left out.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_shards = shards_for(texts, "text", SHARD_BYTES)
    anchors = _recurring(texts, length, n_shards)
    units = _repeats(texts, anchors, length, n_shards)
    carry = [c for c in carry if c not in (id_col, "n_bytes", "n_removed", "n_spans", out_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, a, b in blocks(batch, length):
                gone = covered(block, anchors, units)
                ptr = block.offsets
                total = np.concatenate([[0], np.cumsum(gone)])
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                inner = ptr[:-1][ptr[:-1] < len(gone)]
                begin[inner] = gone[inner]  # runs end with their document
                begins = np.concatenate([[0], np.cumsum(begin)])
                removed = total[ptr[1:]] - total[ptr[:-1]]
                kept = []
                for i in range(b - a):
                    text = block.data[ptr[i] : ptr[i + 1]]
                    text = (text[~gone[ptr[i] : ptr[i + 1]]] if removed[i] else text).tobytes()
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text)
                cols = [pa.array(np.diff(ptr), pa.int64()), pa.array(removed, pa.int64()), pa.array(begins[ptr[1:]] - begins[ptr[:-1]], pa.int64()), pa.array(kept, pa.string() if digest else pa.binary())]
                carried = [batch.column(2 + i).slice(a, b - a) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *cols, *carried], names=names)

    names = ["id", "n_bytes", "n_removed", "n_spans", "out", *[f"_c{i}" for i in range(len(carry))]]
    kinds = ["long"] * 4 + ["string" if digest else "binary"] + [df.schema[c].dataType.simpleString() for c in carry]
    whole = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    out = whole.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    back = [F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)]
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "n_spans", F.col("out").alias(out_col), *back)
