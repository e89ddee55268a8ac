"""Sorted integers in few bytes, and rows that carry many of them.

Tasks that exchange millions of integers send them as a few binary rows, each for one place of the
next step, instead of one row per integer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard

# Names that are not worth a search for equal ones.
FEW = 32


def give_back() -> None:
    """Return what freed arrays and batches held to the system: a worker keeps it otherwise, task after task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@cache
def _squeezer() -> zstandard.ZstdCompressor:
    """Set up once in a process: a task packs small rows by the thousand."""
    return zstandard.ZstdCompressor(level=1)


@cache
def _opener() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def squeezed(values: np.ndarray) -> bytes:
    """Ascending unsigned integers: differences, byte plane by byte plane, compressed."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return _squeezer().compress(planes.tobytes())


def expanded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_opener().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def plain(values: np.ndarray) -> bytes:
    """Small integers or floats in any order, compressed."""
    return _squeezer().compress(np.ascontiguousarray(values).tobytes())


def unplain(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(_opener().decompress(data), kind)


def tagged(owners: np.ndarray) -> bytes:
    """Few distinct 64-bit names in any order: a table and a place in it each."""
    # A few names are their own table.
    table, at = (owners, np.arange(len(owners))) if len(owners) <= FEW else np.unique(owners, return_inverse=True)
    small = np.uint16 if len(table) <= 1 << 16 else np.uint32
    return len(table).to_bytes(4, "little") + plain(np.concatenate([table.view(np.uint8), at.astype(small).view(np.uint8)]))


def untagged(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    raw = unplain(data[4:], np.uint8)
    return raw[: 8 * n].view(np.int64)[raw[8 * n :].view(np.uint16 if n <= 1 << 16 else np.uint32)]


def by_place(places: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, which rows) in order of place; rows of a place stay in their order."""
    order = np.argsort(places, kind="stable")
    edges = np.searchsorted(places[order], np.arange(count + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        yield p, order[edges[p] : edges[p + 1]]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, each with the sum of its counts."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    if not len(key):
        return key, count
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[starts], np.add.reduceat(count, starts)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(value of the first column, its rows) of rows that come ordered by that column."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[0] != now:
                if rows:
                    yield now, rows
                now, rows = row[0], []
            rows.append(row)
    if rows:
        yield now, rows
