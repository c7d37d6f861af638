"""Sorted hash arrays in the shared folder, memory-mapped by the workers.

Tasks send hashes (with payload columns) packed by shard in binary columns; a shard is
merged by one task, which writes its arrays under final names by an atomic rename, so a
repeated task only rewrites the same bytes. Keys are uniform hashes: shards are even
whatever the data, and equal keys of one block were combined before they were sent.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

U64 = np.uint64


def _local(path: str) -> str | None:
    scheme = urlparse(path).scheme
    return urlparse(path).path if scheme == "file" else path if not scheme else None


def put_array(path: str, values: np.ndarray) -> None:
    """Write an array under its final name in one step."""
    if local := _local(path):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        values.tofile(part := f"{local}.{uuid.uuid4().hex}")
        os.replace(part, local)
        return
    fs, name = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(os.path.dirname(name), recursive=True)
    with fs.open_output_stream(part := f"{name}.{uuid.uuid4().hex}") as f:
        f.write(values.tobytes())
    fs.move(part, name)


def map_array(path: str, dtype) -> np.ndarray:
    """Memory-map an array; from a store that is no mounted folder, read it. A missing file is an error."""
    if local := _local(path):
        return np.memmap(local, dtype=dtype, mode="r") if os.path.getsize(local) else np.zeros(0, dtype)
    fs, name = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def find(keys: np.ndarray, wanted: np.ndarray):
    """(position, hit) of each wanted value in sorted keys."""
    at = np.searchsorted(keys, wanted)
    inside = at < len(keys)
    hit = inside.copy()
    hit[inside] = keys[at[inside]] == wanted[inside]
    return at, hit


def _shard_order(shard: np.ndarray, n_shards: int) -> np.ndarray:
    """Stable order by shard; numbers of 16 bits are sorted by digits."""
    return np.argsort(shard.astype(np.uint16) if n_shards <= 1 << 16 else shard, kind="stable")


def pack(keys: np.ndarray, payload: list[np.ndarray], n_shards: int, shard: np.ndarray | None = None) -> pa.RecordBatch:
    """One row (shard, keys, payload...) of binary columns for each shard."""
    shard = (keys % U64(n_shards)).astype(np.int64) if shard is None else shard
    order = _shard_order(shard, n_shards)
    cut = np.searchsorted(shard[order], np.arange(n_shards + 1))
    used = np.flatnonzero(np.diff(cut))
    cols = [x[order] for x in (keys, *payload)]
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32())] + [pa.array([c[cut[s] : cut[s + 1]].tobytes() for s in used], pa.binary()) for c in cols],
        names=["shard", *[f"b{i}" for i in range(len(cols))]],
    )


def packed_schema(n: int) -> str:
    return ", ".join(["shard int", *[f"b{i} binary" for i in range(n)]])


def unpack(table: pa.Table, dtypes: list) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x, t) for x in table.column(f"b{i}").to_pylist()]) for i, t in enumerate(dtypes)]


class HashArrays:
    """A map from 64-bit hashes to columns, kept as one sorted array a shard.

    ``sizes`` names the shards that were written and their number of keys; a shard that a
    worker cannot find, or finds shorter, raises instead of looking empty.
    """

    def __init__(self, base: str, n_shards: int, columns: dict[str, str]):
        self.base, self.n_shards, self.columns = base, n_shards, columns
        self.sizes: dict[int, int] = {}
        self.mapped: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {**self.__dict__, "mapped": {}}

    @staticmethod
    def named(df: DataFrame, label: str, columns: dict[str, str], n_shards: int | None = None) -> HashArrays:
        n = n_shards or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return HashArrays(f"{shared_dir(df.sparkSession)}/lapforge/{label}-{uuid.uuid4().hex}", n, columns)

    def fill(self, packed: DataFrame, merge: Callable[[pa.Table], tuple[np.ndarray, dict[str, np.ndarray]]]) -> int:
        """Write every shard from merge(rows of the shard) = (keys, columns); returns the number of keys."""

        def run(rows: pa.Table) -> pa.Table:
            shard = rows.column("shard")[0].as_py()
            keys, cols = merge(rows)
            order = np.argsort(keys)
            put_array(f"{self.base}/{shard}.key", keys[order])
            for name, kind in self.columns.items():
                put_array(f"{self.base}/{shard}.{name}", cols[name][order].astype(kind))
            return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

        # one row a shard, so no more rows than tasks
        self.sizes = {r["shard"]: r["n"] for r in packed.groupBy("shard").applyInArrow(run, "shard int, n long").collect()}
        return sum(self.sizes.values())

    def _array(self, shard: int, name: str, dtype) -> np.ndarray:
        at = (shard, name)
        if at not in self.mapped:
            size = self.sizes.get(shard, 0)
            self.mapped[at] = map_array(f"{self.base}/{shard}.{name}", dtype) if size else np.zeros(0, dtype)
            if len(self.mapped[at]) != size:
                raise OSError(f"{self.base}/{shard}.{name} holds {len(self.mapped[at])} of {size} values")
        return self.mapped[at]

    def lookup(self, keys: np.ndarray, dealt_by: np.ndarray | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(hit, columns) of keys in any order; columns are 0 where there is no hit.

        ``dealt_by``: hashes that the keys were dealt to shards by, if not their own.
        """
        hit = np.zeros(len(keys), dtype=bool)
        out = {name: np.zeros(len(keys), dtype=kind) for name, kind in self.columns.items()}
        shard = ((keys if dealt_by is None else dealt_by) % U64(self.n_shards)).astype(np.int64)
        order = np.argsort(keys)  # sorted probes touch each page of a shard once
        order = order[_shard_order(shard[order], self.n_shards)]
        cut = np.searchsorted(shard[order], np.arange(self.n_shards + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            rows = order[cut[s] : cut[s + 1]]
            at, ok = find(self._array(s, "key", U64), keys[rows])
            hit[rows] = ok
            for name, kind in self.columns.items():
                out[name][rows[ok]] = self._array(s, name, kind)[at[ok]]
        return hit, out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w values (by doubling)."""
    out, width = x, 1
    while width < w:
        step = min(width, w - width)
        out = np.minimum(out[: len(out) - step], out[step:])
        width += step
    return out


def minimizers(gram: np.ndarray, ptr: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least value of at least one run of w values inside their row.

    Rows are gram[ptr[i]:ptr[i+1]]; a shorter row has no run. Equal runs pick equal
    positions, so shared runs share a pick.
    """
    n = len(gram)
    if n < w:
        return np.zeros(0, np.int64)
    low = sliding_min(gram, w)
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    whole = row[: n - w + 1] == row[w - 1 :]
    low = np.where(whole, low, U64(0))  # runs across rows pick nothing
    # gram[i] is a pick if it equals the largest of the minima of the runs that hold it
    padded = np.concatenate([np.zeros(w - 1, U64), low, np.zeros(w - 1, U64)])
    top = ~sliding_min(~padded, w)
    return np.flatnonzero((gram == top) & (top > 0))


def held_starts(value: np.ndarray, at: np.ndarray, width: int, floor: np.ndarray, ceiling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) start of the runs of ``width`` values whose leftmost least value is each pick.

    ``at`` are the sorted places that hold the least value of some run (ties included),
    ``floor`` and ``ceiling`` the first and last start in the row of each. Where last is
    before first, the pick is the leftmost of no run. A pick holds the starts from which no
    earlier value is as small, up to those that reach a smaller one; both bounds are picks.
    """
    low = value[at]
    first, last = np.maximum(at - width + 1, floor), np.minimum(at, ceiling)
    open_, lag = np.arange(len(at)), 1
    while len(open_):
        open_ = open_[open_ >= lag]
        open_ = open_[at[open_ - lag] >= first[open_]]
        found = low[open_ - lag] <= low[open_]
        first[open_[found]] = at[open_[found] - lag] + 1
        open_, lag = open_[~found], lag + 1
    open_, lag = np.arange(len(at)), 1
    while len(open_):
        open_ = open_[open_ + lag < len(at)]
        open_ = open_[at[open_ + lag] - width < last[open_]]
        found = low[open_ + lag] < low[open_]
        last[open_[found]] = at[open_[found] + lag] - width
        open_, lag = open_[~found], lag + 1
    return first, last


def units(value: np.ndarray, ptr: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pick, first start, last start) of the units of rows value[ptr[i]:ptr[i+1]]: every run of ``width`` values lies in one."""
    at = minimizers(value, ptr, width)
    row = np.searchsorted(ptr, at, "right") - 1
    first, last = held_starts(value, at, width, ptr[row], ptr[row + 1] - width)
    used = first <= last
    return at[used], first[used], last[used]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i] .. start[i] + count[i] - 1, one after the other."""
    step = np.repeat(start - (np.cumsum(count) - count), count)
    return step + np.arange(len(step))


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    change = np.ones(len(keys[0]), bool)
    change[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(change)


def reduced(ufunc, values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """ufunc.reduceat that knows the empty array."""
    return ufunc.reduceat(values, start) if len(start) else values[:0]
