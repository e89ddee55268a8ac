"""Edges between sets that may link, by the prefixes of their members, rarest first.

Sets whose relation reaches a threshold share a member of their prefixes in any one order of all
members. Here that order is by how many sets have a member, so what many share is rarely in a prefix.

1. Sets are kept at the home of their class. A batch asks the place of each of its hashes once, with
   how many of its sets have it, and gets the number of all sets that do.
2. At home the prefixes are taken. Sets with the same hash and band of sizes hang on the smallest of
   the home, and only that one goes to the place of hash and band, to hang on the smallest of all.

A hash costs a place as many rows as batches have it, not as sets do. Rows are packed as in shared_sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gitloom.llm.packed import by_place, expanded, give_back, groups, plain, squeezed, summed, tagged, unplain, untagged
from gitloom.llm.shared_sets import combined, place_of, place_of_owner

SENT = "place int, kind int, a binary, b binary, c binary, d binary"
SETS, ASKED, TOLD, LOWS, EDGES = range(5)


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["place", "kind", "a", "b", "c", "d"]
    )


def _asked(count: int):
    """From (class, n, hashes) to the sets for their homes, and what these ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names, sizes = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1))
            held = [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(2)]
            lengths = np.array([len(h) for h in held], np.int64)
            rows = []
            for home, at in by_place(place_of_owner(names, count), count):
                hashes = np.concatenate([held[i] for i in at.tolist()])
                rows.append((home, SETS, plain(names[at]), plain(sizes[at]), plain(lengths[at]), plain(hashes)))
                every, sets = np.unique(hashes, return_counts=True)
                rows += [
                    (p, ASKED, home.to_bytes(4, "little"), squeezed(every[w]), plain(sets[w].astype(np.int64)), b"")
                    for p, w in by_place(place_of(every, count), count)
                ]
            yield _sent(rows)
            del held, rows
            give_back()

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At the place of a hash: every home that asked is told how many sets have it, if more than one."""
    for _, rows in groups(batches):
        passed = [r for r in rows if r[1] == SETS]
        if passed:
            yield _sent(passed)
        asked = [(int.from_bytes(r[2], "little"), expanded(r[3]), unplain(r[4], np.int64)) for r in rows if r[1] == ASKED]
        every, sets = summed([a[1] for a in asked], [a[2] for a in asked])
        found = []
        for home, hashes, _ in asked:
            n = sets[np.searchsorted(every, hashes)]
            if (n > 1).any():
                found.append((home, TOLD, b"", squeezed(hashes[n > 1]), plain(n[n > 1]), b""))
        if found:
            yield _sent(found)
        del rows, passed, asked, every, sets, found
        give_back()


def _lowest(names: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, the smallest name of each, and the pairs of another name and that one)."""
    order = np.lexsort((names, keys))
    names, keys = names[order], keys[order]
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    low = names[fresh][np.cumsum(fresh) - 1]
    other = names != low
    return keys[fresh], names[fresh], names[other], low[other]


def _once(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    fresh = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])[: len(u)]
    return u[fresh], v[fresh]


def _prefixes(count: int, percent: int):
    """At home: edges between its sets, and the smallest set of each hash and band for their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, rows in groups(batches):
            held, told = ([r for r in rows if r[1] == kind] for kind in (SETS, TOLD))
            if not told:
                continue
            names, sizes, lengths = (np.concatenate([unplain(r[i], np.int64) for r in held]) for i in (2, 3, 4))
            hashes = np.concatenate([unplain(r[5], np.uint64) for r in held])
            known, first = np.unique(np.concatenate([expanded(r[3]) for r in told]), return_index=True)
            sets = np.concatenate([unplain(r[4], np.int64) for r in told])[first]
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            sets = np.where(known[at] == hashes, sets[at], 1)
            owner = np.repeat(np.arange(len(names)), lengths)
            order = np.lexsort((hashes, sets, owner))
            nth = np.arange(len(order)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            least = -(-sizes * percent // 100)
            chosen = order[(nth <= np.repeat(lengths - least, lengths)) & (sets[order] > 1)]
            who = owner[chosen]
            # Sets that can link are less than a step of sizes apart.
            step = np.floor(np.log(sizes) / np.log(101.0 / percent)).astype(np.uint64)[who]
            bands = np.concatenate([step, step + np.uint64(1)])
            keys, lows, u, v = _lowest(np.tile(names[who], 2), combined([np.tile(hashes[chosen], 2), bands]))
            u, v = _once(u, v)
            found = [(p, LOWS, tagged(lows[w]), squeezed(keys[w]), b"", b"") for p, w in by_place(place_of(keys, count), count)]
            if len(u):
                found.append((home, EDGES, tagged(u), tagged(v), b"", b""))
            if found:
                yield _sent(found)
            del rows, held, told, hashes, known, at, sets, owner, order, nth, chosen, who, keys, lows, found
            give_back()

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in groups(batches):
        here = [r for r in rows if r[1] == LOWS]
        pairs = [(untagged(r[2]), untagged(r[3])) for r in rows if r[1] == EDGES]
        if here:
            lows = np.concatenate([untagged(r[2]) for r in here])
            pairs.append(_lowest(lows, np.concatenate([expanded(r[3]) for r in here]))[2:])
        u, v = _once(*(np.concatenate(c) for c in zip(*pairs)))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        del rows, here, pairs
        give_back()


def edges(sets: DataFrame, count: int, percent: int) -> DataFrame:
    """(u, v): pairs of classes of *sets* (class, n, hashes) that connect all classes that may link.

    n is the size of the whole set, of which *hashes* may leave out what no other has. *count* is the
    number of places.
    """
    spread = lambda f: f.repartition("place").sortWithinPartitions("place")
    told = spread(sets.mapInArrow(_asked(count), SENT)).mapInArrow(_told, SENT)
    lows = spread(told).mapInArrow(_prefixes(count, percent), SENT)
    return spread(lows).mapInArrow(_edges, "u long, v long")
