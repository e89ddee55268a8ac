"""Which members of many sets other sets have too, without ever forming pairs.

Members are 64-bit hashes. A batch of sets sends every member to a place chosen by its hash: with
its owner if one set of the batch has it, once and without owners if several have, as it is shared
already and its owners are told directly. So what a place gets for one member grows with the number
of batches, not of owners. Rows between tasks are packed: sorted hashes as compressed differences.
The rows that the sets were made from can come along, so that no set has to be made twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from gitloom.llm.packed import by_place, expanded, give_back, groups, plain, squeezed, tagged, unplain, untagged

MIX = np.uint64(0x9E3779B97F4A7C15)
FINISH = np.uint64(0xFF51AFD7ED558CCD)
SHIFT = np.uint64(32)
# Hashes of a batch that are sorted at a time.
SLICE = 1 << 19

PACKED = "place int, kind int, owners binary, hashes binary"
LONE, HELD, SHARED, SIZES, ROWS = range(5)


def combined(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of several columns of hashes, row by row."""
    total = np.full(len(columns[0]), np.uint64(len(columns)))
    for column in columns:
        total = (total ^ column) * MIX
        total ^= total >> SHIFT
    total *= FINISH
    return total ^ (total >> SHIFT)


def place_of(hashes: np.ndarray, count: int) -> np.ndarray:
    """Places are ranges of hashes, so what a batch sends to one lies close together."""
    return (((hashes >> SHIFT) * np.uint64(count)) >> SHIFT).astype(np.int32)


def place_of_owner(owners: np.ndarray, count: int) -> np.ndarray:
    return place_of(combined([owners.astype(np.int64).view(np.uint64)]), count)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary()
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["place", "kind", "owners", "hashes"]
    )


def _dealt(kind: int, owners: np.ndarray, hashes: np.ndarray, places: np.ndarray, count: int) -> list[tuple]:
    """Rows for each place; *hashes* ascend."""
    return [(p, kind, tagged(owners[at]), squeezed(hashes[at])) for p, at in by_place(places, count)]


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _whole(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _spread(batches: Iterator[pa.RecordBatch], count: int, along: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, first = np.unique(np.asarray(batch.column(0)), return_index=True)
        sizes = np.asarray(batch.column(1))[first].astype(np.int64)
        column = batch.column(2)
        held, owned, load = [], [], 0
        for name, at in zip(names.tolist(), first.tolist()):
            values = np.frombuffer(column[at].as_buffer(), np.uint64)
            held.append(values)
            owned.append(name)
            load += len(values)
            if load > SLICE:
                yield from _sent(held, owned, count)
                held, owned, load = [], [], 0
        yield from _sent(held, owned, count)
        rows = [
            (p, SIZES, tagged(names[at]), plain(sizes[at]))
            for p, at in by_place(place_of_owner(names, count), count)
        ]
        if along and batch.num_rows:
            data = _whole(batch.select(["class", "n", *along]))
            place = place_of(np.array([xxhash.xxh3_64_intdigest(data)], np.uint64), count)
            rows.append((int(place[0]), ROWS, data, b""))
        if rows:
            yield _packed(rows)
        del batch, column, held, rows
        give_back()


def _sent(held: list[np.ndarray], owned: list[int], count: int) -> Iterator[pa.RecordBatch]:
    if not any(map(len, held)):
        return
    hashes = np.concatenate(held)
    owners = np.repeat(np.array(owned, np.int64), [len(h) for h in held])
    order = np.argsort(hashes)
    hashes, owners = hashes[order], owners[order]
    same = np.concatenate([[False], hashes[1:] == hashes[:-1]])
    many = same | np.append(same[1:], False)
    rows = _dealt(LONE, owners[~many], hashes[~many], place_of(hashes[~many], count), count)
    once = hashes[many & ~same]
    rows += _dealt(HELD, np.zeros(len(once), np.int64), once, place_of(once, count), count)
    rows += _dealt(SHARED, owners[many], hashes[many], place_of_owner(owners[many], count), count)
    if rows:
        yield _packed(rows)


def _meet(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    for place, rows in groups(batches):
        passed = [r for r in rows if r[1] in (SHARED, SIZES, ROWS)]
        if passed:
            yield _packed(passed)
        owners = _joined([untagged(r[2]) for r in rows if r[1] == LONE], np.int64)
        hashes = _joined([expanded(r[3]) for r in rows if r[1] == LONE], np.uint64)
        known = [expanded(r[3]) for r in rows if r[1] == HELD]
        if not len(hashes):
            continue
        order = np.argsort(hashes)
        hashes, owners = hashes[order], owners[order]
        del order
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        lengths = np.diff(np.append(starts, len(hashes)))
        # Several batches may hold one owner, so owners count, not entries.
        differ = np.repeat(owners[starts], lengths) != owners
        shared = np.add.reduceat(differ, starts) > 0
        if known:
            every = np.unique(np.concatenate(known))
            at = np.minimum(np.searchsorted(every, hashes[starts]), len(every) - 1)
            shared |= every[at] == hashes[starts]
        keep = np.repeat(shared, lengths)
        hashes, owners = hashes[keep], owners[keep]
        del differ, keep, lengths, shared, starts
        rows = _dealt(SHARED, owners, hashes, place_of_owner(owners, count), count)
        if rows:
            yield _packed(rows)
        del hashes, owners, known, rows
        give_back()


def _gather(batches: Iterator[pa.RecordBatch], percent: int, along: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    for _, rows in groups(batches):
        for data in [r[2] for r in rows if r[1] == ROWS]:
            for read in pa.ipc.open_stream(data):
                columns = [read.column("class"), read.column("n"), pa.nulls(len(read), pa.binary())]
                columns += [read.column(c) for c in along]
                yield pa.RecordBatch.from_arrays(columns, ["class", "n", "hashes", *along])
        names, at = np.unique(
            _joined([untagged(r[2]) for r in rows if r[1] == SIZES], np.int64), return_index=True
        )
        sizes = _joined([unplain(r[3], np.int64) for r in rows if r[1] == SIZES], np.int64)[at]
        owners = _joined([untagged(r[2]) for r in rows if r[1] == SHARED], np.int64)
        hashes = _joined([expanded(r[3]) for r in rows if r[1] == SHARED], np.uint64)
        if not len(owners):
            continue
        order = np.lexsort((hashes, owners))
        owners, hashes = owners[order], hashes[order]
        fresh = np.concatenate([[True], (owners[1:] != owners[:-1]) | (hashes[1:] != hashes[:-1])])
        owners, hashes = owners[fresh], hashes[fresh]
        low, high = np.searchsorted(owners, names), np.searchsorted(owners, names, side="right")
        enough = np.flatnonzero((high > low) & ((high - low) * 100 >= percent * sizes)).tolist()
        if enough:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names[enough]),
                    pa.array(sizes[enough]),
                    pa.array([hashes[low[i] : high[i]].tobytes() for i in enough], pa.binary()),
                    *[pa.nulls(len(enough), pa.int64()) for _ in along],
                ],
                ["class", "n", "hashes", *along],
            )
        del owners, hashes, order, fresh
        give_back()


def shared_sets(source: DataFrame, make: Callable, count: int, percent: int, along: tuple[str, ...] = ()) -> DataFrame:
    """(class, n, hashes, along…): of each set the members that another set has too.

    *make* turns batches of *source* into batches of (class, n, hashes): equal classes are one set, n
    is its size, hashes are its members as bytes. Sets of which less than *percent* is shared, or
    nothing, are left out. *count* is the number of places, each a group of one task.

    *along* names columns of longs that *make* gives too. With them every row that *make* gave comes back as well,
    with its class, n and these columns but without hashes; the rows of the sets have NULL in them.
    """
    # Bound here, as functions are shipped with what they refer to.
    met = (
        source.mapInArrow(lambda batches: _spread(make(batches), count, along), PACKED)
        .repartition("place")
        .sortWithinPartitions("place")
        .mapInArrow(lambda batches: _meet(batches, count), PACKED)
    )
    home = met.repartition("place").sortWithinPartitions("place")
    schema = ", ".join(["class long, n long, hashes binary", *(f"{c} long" for c in along)])
    return home.mapInArrow(lambda batches: _gather(batches, percent, along), schema)
