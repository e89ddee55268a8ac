"""Blocks of vectors that stay, and the vectors of a query set that pass by them.

Rows become integers, are dealt over shards by hash, and a shard with all queries sent to it is one
sorted run of a task: its own rows come first and are indexed once, then the queries stream past.
What a task holds is one shard and one Arrow batch of queries, whatever the tables hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Layout:
    """shard_values: components in one shard's index; group_values: components of the queries that share one index."""

    shard_values: int = 1 << 19
    group_values: int = 1 << 26


def whole_numbers(table: DataFrame, key: str, vector: str, scale: float, *more: Column) -> DataFrame:
    """(id, dim, v, more…): floor(scale * x) of the rows that take part, as longs, which saturate."""
    as_double = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    slim = table.select(F.col(f"`{key}`").cast("long").alias("id"), as_double.alias("v"), *more)
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("v", lambda x: F.floor(x * F.lit(scale)))
    usable = slim.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & sound)
    return usable.withColumn("v", whole).withColumn("dim", F.size("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of *dim* longs a row as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def large_products(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of numbers too large for doubles, as Python integers."""
    return points.astype(object) @ query.astype(object) if points.shape[1] else np.zeros(len(points), object)


def as_long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array([max(-LONG - 1, min(LONG, int(s))) for s in scores], dtype=np.int64)
    return scores.astype(np.int64)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    places = np.arange(len(scores))
    if len(scores) > 4 * k and scores.dtype != object:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    if scores.dtype == object:
        return np.array(sorted(places, key=lambda p: (-scores[p], ids[p]))[:k], dtype=int)
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def meet(
    stay: DataFrame,
    asked: DataFrame,
    build: Callable[[pa.RecordBatch, int], object],
    answer: Callable[[object, pa.RecordBatch, int], pa.RecordBatch],
    result: T.StructType,
    layout: Layout,
) -> DataFrame:
    """What *answer* gives for every row of *asked* against the index of every shard of *stay*.

    Both frames hold (id, dim, v) and are tables or cheap to read twice. Columns beyond those may
    differ; each side finds its own. Vectors of different dimension do not meet.
    """
    weigh = lambda f: f.agg(F.sum("dim").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    held, passing = weigh(stay), weigh(asked)
    shards = max(1, -(-(held["n"] or 0) // layout.shard_values), -(-held["rows"] // layout.shard_values))
    groups = max(1, -(-(passing["n"] or 0) // layout.group_values))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Rows are dealt by their place too, so that any number of equal rows spreads.
    dealt = lambda n, seed: F.pmod(F.xxhash64("id", F.monotonically_increasing_id(), F.lit(seed)), F.lit(n)).cast("int")
    left = stay.select(F.struct(*stay.columns).alias("stays"), "dim", dealt(shards, 0).alias("shard"))
    right = asked.select(F.struct(*asked.columns).alias("passes"), "dim", dealt(groups, 1).alias("group"))
    left, right = left.withColumn("group", every(groups)), right.withColumn("shard", every(shards))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("turn", F.col("stays").isNull())
    keys = ["dim", "shard", "group"]
    spread = both.repartition(min(2 * shards * groups, 1 << 16), *keys).sortWithinPartitions(*keys, "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*keys, "turn")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if end == start:
                    continue
                place, turn = tuple(key[:3, start]), key[3, start]
                if place != at:
                    at, held, index = place, [], None
                part = batch.slice(start, end - start)
                if not turn:
                    held.append(pa.RecordBatch.from_struct_array(part.column("stays")))
                    continue
                if index is None and held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    held, index = [], build(table.to_batches()[0], int(place[0]))
                if index is not None:
                    yield answer(index, pa.RecordBatch.from_struct_array(part.column("passes")), int(place[0]))

    return spread.mapInArrow(run, result)


def distinct_queries(rows: DataFrame, is_query: Column) -> DataFrame:
    """The queries, each once: equal rows ask the same. ``ask`` keeps different rows of one id apart."""
    told = [c for c in rows.columns if c not in ("id", "dim")]
    return rows.filter(is_query).dropDuplicates().withColumn("ask", F.xxhash64(*told))
