"""Byte-level BPE encoding and decoding with published merge ranks.

Method: the distinct pre-tokens of a block are bucketed by length into padded numpy
matrices. In each round every row merges its leftmost pair of minimum rank; pair ranks
come from an open-addressing hash table over (left id, right id), and finished rows are
compacted away. Decoding is one gather over the concatenated token bytes.

Only the ranks (a fixed vocabulary file) are sent to the workers. Documents stay in
their input partitions: no shuffle, and a lost executor only repeats its own tasks.

Edge cases: a null or empty text has no tokens and decodes to empty bytes; a pre-token
longer than ``LONG_PIECE`` bytes is merged with a heap over a linked list, which merges
the same pairs in the same order in n log n; columns of the input whose names clash
with an output column are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LONG_PIECE = 256
BLOCK_BYTES = 1 << 20
CACHE_PIECES = 200_000
NONE = np.int32(2**31 - 1)

# No code point from here on is a letter or number.
LETTERS_END = 0x33480

# Unicode White_Space, which the rank files' splitting pattern means by \s.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType(), False),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded": T.BinaryType(),
    "decoded_sha256": T.StringType(),
}


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: a base64 token and its rank on every line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Splitter:
    """Splits texts by a pattern of \\s, \\S, \\p{L} and \\p{N}.

    The standard library's matcher is twice as fast but knows no properties, so they are
    given as explicit ranges: of the basic plane for it, and of all planes that hold
    letters for ``regex``, which takes the texts with higher code points. (``regex``
    itself counts a few unassigned code points above those planes as letters.)
    """

    def __init__(self, pattern: str):
        spaced = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")
        self.basic_plane = re.compile(self._explicit(spaced, 0x10000))
        self.any_plane = regex.compile(self._explicit(spaced, LETTERS_END))

    @staticmethod
    def _explicit(pattern: str, end: int) -> str:
        plane = "".join(map(chr, [*range(0xD800), *range(0xE000, end)]))
        for name in (r"\p{L}", r"\p{N}"):
            runs = "".join(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}" for m in regex.finditer(f"{name}+", plane))
            pattern = regex.sub(r"(?<=\[\^[^\]]*)" + regex.escape(name), lambda _: runs, pattern).replace(name, f"[{runs}]")
        return pattern

    def findall(self, text: str) -> list[str]:
        basic = len(text.encode("utf-16-le")) == 2 * len(text)
        return (self.basic_plane if basic else self.any_plane).findall(text)


class Codec:
    """Tables for one vocabulary, with a bounded cache of encoded pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.splitter = Splitter(pattern)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, i in ranks.items():
            tokens[i] = token
        self.token_len = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        pairs = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = i
        self._build(np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self._forget()

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # one key settles in each free slot per round; the rest move on
            free = self.keys[slot[todo]] == np.iinfo(np.uint64).max
            _, one = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][one]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NONE; a negative id pads and pairs with nothing."""
        key = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found != np.iinfo(np.uint64).max))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != np.iinfo(np.uint64).max)]
        out[(left < 0) | (right < 0)] = NONE
        return out

    def _merge_matrix(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row of a padded id matrix to the end; (rows, lengths)."""
        n, width = ids.shape
        done, lengths, where = np.full((n, width), -1, dtype=np.int32), np.zeros(n, dtype=np.int64), np.arange(n)
        rank = self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1) if width > 1 else np.full((n, 1), NONE)
        while True:
            at = rank.argmin(axis=1)  # the first of equal minima: the leftmost pair
            best = rank[np.arange(len(at)), at]
            ended = best == NONE
            if ended.any():
                rows = where[ended]
                done[rows, : ids.shape[1]] = ids[ended]
                lengths[rows] = (ids[ended] >= 0).sum(axis=1)
                ids, rank, at, best, where = (x[~ended] for x in (ids, rank, at, best, where))
            if not len(where):
                return done, lengths
            r, col = np.arange(len(at)), np.arange(ids.shape[1] - 1)
            ids[r, at] = best
            ids = np.where(col[None, :] <= at[:, None], ids[:, :-1], ids[:, 1:])  # closes the gap at the merged right half
            if ids.shape[1] == 1:
                rank = np.full((len(at), 1), NONE)
                continue
            col = col[:-1]
            rank = np.where(col[None, :] < at[:, None], rank[:, :-1], rank[:, 1:])
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < ids.shape[1] - 1)
            rank[left, at[left] - 1] = self.pair_rank(ids[left, at[left] - 1], ids[left, at[left]])
            rank[right, at[right]] = self.pair_rank(ids[right, at[right]], ids[right, at[right] + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        first = self.pair_rank(ids[:-1], ids[1:])
        token, n = ids.tolist(), len(ids)
        prev, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(int(k), int(i), token[i], token[i + 1]) for i, k in enumerate(first) if k != NONE]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            k = int(self.pair_rank(np.array([token[i]], np.int32), np.array([token[j]], np.int32))[0])
            if k != NONE:
                heapq.heappush(heap, (k, i, token[i], token[j]))

        while heap:
            k, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue  # one of its halves has been merged since
            token[i], token[j] = k, -1
            after[i] = after[j]
            if after[i] < n:
                prev[after[i]] = i
                push(i, after[i])
            if prev[i] >= 0:
                push(prev[i], i)
        return np.array([t for t in token if t >= 0], dtype=np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of pre-tokens, each merged separately."""
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        data = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        counts, parts = np.zeros(len(pieces), dtype=np.int64), []
        low = 0
        while low < LONG_PIECE:
            high = max(1, low * 2)
            rows = np.flatnonzero((size > low) & (size <= high))
            for chunk in (rows[i : i + max(1, (1 << 21) // high)] for i in range(0, len(rows), max(1, (1 << 21) // high))):
                width = int(size[chunk].max())
                grid = np.arange(width)
                inside = grid[None, :] < size[chunk][:, None]
                ids = np.full(inside.shape, -1, dtype=np.int32)
                ids[inside] = data[(at[chunk][:, None] + grid)[inside]]
                merged, counts[chunk] = self._merge_matrix(ids)
                parts.append((chunk, merged[merged >= 0]))
            low = high
        for i in np.flatnonzero(size > LONG_PIECE):
            ids = self._merge_long(pieces[i])
            counts[i] = len(ids)
            parts.append((np.array([i]), ids))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(offsets[-1], dtype=np.int32)
        for chunk, flat in parts:
            out[_ranges(offsets[chunk], counts[chunk])] = flat
        return out, offsets

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.known_ids, self.known_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of whole texts."""
        split = [self.splitter.findall(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(split))
        fresh = list(set(flat) - self.known.keys())
        if fresh:
            if len(self.known) > CACHE_PIECES:
                self._forget()
                fresh = list(set(flat))
            ids, at = self.encode_pieces([p.encode() for p in fresh])
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            self.known_at = np.concatenate([self.known_at, at[1:] + len(self.known_ids)])
            self.known_ids = np.concatenate([self.known_ids, ids])
        piece = np.array(list(map(self.known.__getitem__, flat)), dtype=np.int64)
        counts = self.known_at[piece + 1] - self.known_at[piece]
        ids = self.known_ids[_ranges(self.known_at[piece], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of consecutive id runs."""
        counts = self.token_len[ids]
        data = self.token_bytes[_ranges(self.token_at[ids], counts)]
        return data, np.concatenate([[0], np.cumsum(counts)])[offsets]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of start[i] .. start[i] + count[i] - 1."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    out = np.ones(total, dtype=np.int64)
    used = count > 0
    start, count = start[used], count[used]
    out[0] = start[0]
    out[np.cumsum(count)[:-1]] = start[1:] - start[:-1] - count[:-1] + 1
    return np.cumsum(out, out=out)


_codecs: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec; one is kept per vocabulary broadcast."""
    if shared.id not in _codecs:
        _codecs.clear()
        _codecs[shared.id] = Codec(*shared.value)
    return _codecs[shared.id]


class _Shared:
    """A broadcast with the id that workers cache by."""

    def __init__(self, df: DataFrame, ranks: dict[bytes, int], pattern: str):
        self.held = df.sparkSession.sparkContext.broadcast((ranks, pattern))
        self.id = uuid.uuid4().hex  # a number of the driver's would come back for another vocabulary

    @property
    def value(self):
        return self.held.value


def _schema(df: DataFrame, kept: list[str], outputs: list[str]) -> T.StructType:
    return T.StructType([df.schema[c] for c in kept] + [T.StructField(o, OUTPUTS[o]) for o in outputs])


def _columns(codec: Codec, ids: np.ndarray, offsets: np.ndarray, outputs: list[str]) -> dict[str, pa.Array]:
    rows, out = len(offsets) - 1, {}
    if "ids" in outputs:
        out["ids"] = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
    if "n_tokens" in outputs:
        out["n_tokens"] = pa.array(np.diff(offsets), pa.int64())
    if "ids_sha256" in outputs:
        raw = memoryview(ids.astype("<u4").tobytes())
        out["ids_sha256"] = pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])], pa.string())
    if "decoded" in outputs or "decoded_sha256" in outputs:
        data, at = codec.decode(ids, offsets)
        parts = [data[at[i] : at[i + 1]].tobytes() for i in range(rows)]
        if "decoded" in outputs:
            out["decoded"] = pa.array(parts, pa.binary())
        if "decoded_sha256" in outputs:
            out["decoded_sha256"] = pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())
    return out


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", outputs: tuple[str, ...] = ("ids",), keep: list[str] | None = None) -> DataFrame:
    """Encode the whole text of every row.

    ``outputs`` are names of OUTPUTS: the ids, their count, digests of ids and of the
    bytes that the ids decode to, or those bytes. ``keep`` lists input columns to carry
    (default: all that don't clash with an output).
    """
    outputs = list(outputs)
    kept = [c for c in (df.columns if keep is None else keep) if c not in outputs]
    shared = _Shared(df, ranks, pattern)
    carried = list(dict.fromkeys([*kept, text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            column = batch.column(carried.index(text_col))
            offsets = np.concatenate([[0], np.cumsum(np.array(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64))])
            start = 0
            while start < len(column):
                end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK_BYTES, "right")) - 1)
                ids, at = codec.encode_texts(column.slice(start, end - start).to_pylist())
                made = _columns(codec, ids, at, outputs)
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([part.column(carried.index(c)) for c in kept] + [made[o] for o in outputs], names=kept + outputs)
                start = end

    return df.select(*carried).mapInArrow(run, _schema(df, kept, outputs))


def decode(df: DataFrame, ranks: dict[bytes, int], pattern: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded``, the bytes that the ids of each row stand for; null ids decode to empty bytes."""
    kept = [c for c in (df.columns if keep is None else keep) if c != "decoded"]
    shared = _Shared(df, ranks, pattern)
    carried = list(dict.fromkeys([*kept, ids_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            lists = batch.column(carried.index(ids_col)).to_pylist()
            ids = np.array([i for x in lists for i in x or ()], dtype=np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            made = _columns(codec, ids, offsets, ["decoded"])
            yield pa.RecordBatch.from_arrays([batch.column(carried.index(c)) for c in kept] + [made["decoded"]], names=[*kept, "decoded"])

    return df.select(*carried).mapInArrow(run, _schema(df, kept, ["decoded"]))
