"""Vectorised word splitting and hashing shared by the text operators.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D (the class
``[^\\x20\\x09-\\x0D]+``; multi-byte UTF-8 never contains those bytes, so the byte
view and the code-point view agree). All routines take one Arrow binary/string
array and work on its value buffer with numpy, so no per-word Python runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LONG = 64  # bytes of a word that are hashed eight at a time
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of the base and of its inverse, grown on demand in each worker."""

    up = np.ones(1, dtype=U64)
    down = np.ones(1, dtype=U64)

    @classmethod
    def to(cls, n: int) -> None:
        n = -(-n // (1 << 18)) * (1 << 18)
        while len(cls.up) < n:
            k = len(cls.up)
            more = min(k, n - k)
            cls.up = np.concatenate([cls.up, cls.up[:more] * U64(pow(_BASE, k, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down[:more] * U64(pow(_INV, k, 1 << 64))])


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_null()), 0, np.diff(offsets))
        if not np.array_equal(lengths, np.diff(offsets)):
            pieces = [data[a : a + k] for a, k in zip(offsets[:-1], lengths)]
            data = np.concatenate(pieces) if pieces else data[:0]
            offsets = np.concatenate([[0], np.cumsum(lengths)])
    return data[offsets[0] : offsets[-1]] if n else data[:0], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int):
    """Consecutive row ranges of about ``limit`` bytes each; a longer row stands alone."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of a byte array, for span_hash."""
    n = len(data)
    _Powers.to(n + 1)
    total = np.empty(n + 1, dtype=U64)
    total[0] = 0
    np.multiply(_BYTE_CODE[data], _Powers.up[:n], out=total[1:])
    return np.cumsum(total, out=total)


def powers_down(n: int) -> np.ndarray:
    """Factors that make the difference of two running sums independent of where it starts."""
    _Powers.to(n)
    return _Powers.down[:n]


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [start, end) whatever their place; mix() before use as a key."""
    return (total[end] - total[start]) * _Powers.down[start]


def lowered(data: np.ndarray) -> np.ndarray:
    """LOWER of every byte."""
    return data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) byte places of the words of consecutive rows."""
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = (data != 0x20) & (data - np.uint8(9) > 4)  # the complement of SPACE
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = inside[cut]  # a row boundary also starts a word
    last = inside[:n].copy()
    last[: n - 1] &= ~inside[1:n]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """Word table of consecutive rows.

    Returns (hash, start, end, row_ptr): a 64-bit hash and the byte span of every
    word, and for each row the index of its first word (length rows + 1).
    """
    if lower:
        data = lowered(data)
    start, end = word_bounds(data, offsets)
    value = span_hash(prefix_hash(data), start, end)
    value = mix(value ^ ((end - start).astype(U64) * U64(_GOLDEN)))
    return value, start, end, np.searchsorted(start, offsets)


def word_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at [start, end), other ones than those of ``words``: eight bytes of a word at a time."""
    size = end - start
    n = len(data)
    eights = np.zeros((n >> 3) + 3, U64)
    eights.view(np.uint8)[:n] = data
    value = size.astype(U64) * U64(_GOLDEN)
    at, left, which = start, size, None
    for _ in range(_LONG // 8):
        place, shift = at >> 3, ((at & 7) << 3).astype(U64)
        # the eight bytes from ``at`` on; a shift by 64 is one by 1 and one by 63
        eight = (eights[place] >> shift) | ((eights[place + 1] << U64(1)) << (U64(63) - shift))
        eight &= _FIRST_BYTES[np.minimum(left, 8)]
        if which is None:
            value = mix(value ^ eight)
        else:
            value[which] = mix(value[which] ^ eight)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return value
        which = more if which is None else which[more]
        at, left = at[more] + 8, left[more] - 8
    # what is left of long words, by running sums over their bytes alone
    stop = np.cumsum(left)
    rest = data[np.repeat(at - (stop - left), left) + np.arange(stop[-1])]
    value[which] = mix(value[which] ^ mix(span_hash(prefix_hash(rest), stop - left, stop)))
    return value


def grams(value: np.ndarray, row_ptr: np.ndarray, k: int):
    """Hashes of all runs of ``k`` words inside one row: (hash, first word, row_ptr of the runs)."""
    counts = np.diff(row_ptr)
    runs = np.maximum(counts - (k - 1), 0)
    ptr = np.concatenate([[0], np.cumsum(runs)])
    row = np.repeat(np.arange(len(counts)), runs)
    first = np.arange(ptr[-1]) - ptr[row] + row_ptr[row]
    # every run, those across rows too, and then those inside a row
    out = np.zeros(max(len(value) - (k - 1), 0), dtype=U64)
    for i in range(k):
        out *= U64(_BASE)
        out += value[i : i + len(out)]
    return mix(out[first]), first, ptr
