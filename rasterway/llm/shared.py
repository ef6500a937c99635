"""Sizing, shared storage and Arrow helpers used by every operator here."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterway.storage import shared_dir, written

__all__ = ["shared_dir", "written"]

#: Text bytes that one unit of grouped work should hold.
GROUP_BYTES = 4 << 20
#: Groups that even small tables are dealt into.
LEAST_GROUPS = 64
#: Text bytes handled at once by the vectorised kernels, and by those that hold some twenty times as many.
CHUNK_BYTES, WIDE_CHUNK_BYTES = 2 << 20, 1 << 19


#: What this worker process keeps from task to task: one model or cache, that of the last operator.
_KEPT: dict[tuple, Any] = {}


def kept(key: tuple, build: Callable[[], Any]) -> Any:
    """What ``build`` gives, made once a process as long as no other key is asked for.

    Workers are used again by other operators; each drops what the one before has left.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def give_back() -> None:
    """Free memory of this process goes back to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` over a task's batches; its worker, which is used again, keeps no freed memory of it."""

    def of_task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return of_task


def lean_group(run: Callable) -> Callable:
    """``run`` of a group's table; no freed memory is kept."""

    def of_group(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return of_group


def lean_groups(run: Callable) -> Callable:
    """``run`` of two tables of a group; no freed memory is kept."""

    def of_groups(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            give_back()

    return of_groups


def groups_for(docs: DataFrame, column: str = "text", group_bytes: int = GROUP_BYTES) -> int:
    """How many hash groups to deal ``docs`` into so that each stays small."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(LEAST_GROUPS, -(-total // group_bytes))


def group_of(column: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def plain(column) -> pa.Array:
    """A column as one array."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def strings(column) -> pa.Array:
    """One string array without nulls."""
    column = plain(column)
    return column.fill_null("").cast(pa.string() if column.nbytes < 2**31 else pa.large_string())


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null counts as empty."""
    a = strings(column)
    wide = np.int64 if pa.types.is_large_string(a.type) else np.int32
    offsets = np.frombuffer(a.buffers()[1], wide)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    body = a.buffers()[2] if len(a) else None
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """(first, last) document ranges of about ``limit`` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def longs(column) -> np.ndarray:
    """int64 values; null becomes the smallest long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)


_ZSTD = pa.Codec("zstd", compression_level=1)


def _hashed(dtype: np.dtype) -> tuple[list[str], list[str]]:
    """Fields that hold hashes, and the others, which compress."""
    return [f for f in dtype.names if f.startswith("key")], [f for f in dtype.names if not f.startswith("key")]


def pack(records: np.ndarray) -> bytes:
    """A structured array as bytes: hashes as they are, other fields by byte planes, compressed."""
    raw, rest = _hashed(records.dtype)
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(records[f]).view(np.uint8).reshape(len(records), -1).T).tobytes() for f in rest)
    head = len(records).to_bytes(8, "little")
    return head + b"".join(np.ascontiguousarray(records[f]).tobytes() for f in raw) + _ZSTD.compress(planes, asbytes=True)


def unpack(blobs, dtype: np.dtype) -> np.ndarray:
    """The records of all ``blobs``, in order."""
    raw, rest = _hashed(dtype)
    parts = []
    for blob in blobs:
        blob = memoryview(blob)
        n, at = int.from_bytes(blob[:8], "little"), 8
        out = np.empty(n, dtype)
        for f in raw:
            out[f] = np.frombuffer(blob, dtype[f], n, at)
            at += n * dtype[f].itemsize
        planes = _ZSTD.decompress(bytes(blob[at:]), sum(dtype[f].itemsize for f in rest) * n, asbytes=True)
        at = 0
        for f in rest:
            size = dtype[f].itemsize
            out[f] = np.ascontiguousarray(np.frombuffer(planes, np.uint8, n * size, at).reshape(size, n).T).view(dtype[f])[:, 0]
            at += n * size
        parts.append(out)
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def dealt(records: np.ndarray, bucket: np.ndarray):
    """(bucket, records) for every bucket that occurs, keeping their order."""
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(sorted_bucket)) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), records[part]
