"""Approximate nearest neighbours by inner product, with vantage-point trees.

Nearest by inner product becomes nearest by distance once every vector gets one more component
that brings all of them to the same length (and queries a zero): |q - x|^2 is then a constant less
2 <q, x>. Candidates are dealt over shards by hash; each shard builds a vantage-point tree. Below a
node a vector lies nearer to or farther from the vantage point than the median distance; a side is
skipped when by the triangle inequality nothing in it can be nearer than the query's k-th so far.
That bound is relaxed by ``factor``: a side is searched if (distance to the border) * factor is
below the k-th distance. Factor 1 searches exactly, larger ones skip more.

Queries go through a tree in blocks, as matrices, and every shard meets every block: a stated set of
queries against all rows. A (shard, block) pair holds a bounded number of vectors on both sides.
The best k of every pair are merged per query. Scores are taken again on the original vectors in
double precision, the same way for equal vectors, so ties are ties.

NULL vectors, zero vectors and those with a NULL or non-finite component take no part. Vectors of
different dimension are never compared. A repeated row is a candidate each time; only rows with the
query's own id are left out. Fewer candidates than k: all of them. Empty table: empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gitloom.session import materialise


@dataclass(frozen=True)
class Search:
    k: int = 20
    factor: float = 1.5
    leaf: int = 256
    shard_rows: int = 16384
    block_rows: int = 4096
    seed: int = 7


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, dim, v): the rows that take part, as doubles."""
    as_double = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    slim = table.select(F.col(f"`{key}`").cast("long").alias("id"), as_double.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    moving = F.exists("v", lambda x: x != 0.0)
    return slim.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & sound & moving).withColumn("dim", F.size("v"))


class Tree:
    """A vantage-point tree over the rows of a matrix, all of one length."""

    def __init__(self, points: np.ndarray, leaf: int, seed: int):
        self.points, self.leaf = points, leaf
        self.random = np.random.default_rng(seed)
        self.root = self._grow(np.arange(len(points)))

    def _grow(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        pivot = self.points[self.random.choice(rows)]
        away = np.sqrt(np.maximum(((self.points[rows] - pivot) ** 2).sum(axis=1), 0.0))
        border = float(np.median(away))
        near = away < border
        if not near.any() or near.all():
            return rows  # equal distances throughout: nothing to divide by
        return pivot, border, self._grow(rows[near]), self._grow(rows[~near])

    def leaves(self, queries: np.ndarray, best, factor: float):
        """(rows, which queries) of every leaf to be read; best(which): their k-th distances so far."""
        return self._walk(self.root, queries, np.arange(len(queries)), np.zeros(len(queries)), best, factor)

    def _walk(self, node, queries, which, least, best, factor):
        open_ = least * factor <= best(which)
        which = which[open_]
        if not len(which):
            return
        if isinstance(node, np.ndarray):
            yield node, which
            return
        pivot, border, near, far = node
        away = np.sqrt(((queries[which] - pivot) ** 2).sum(axis=1))
        inside = away < border
        gap, least = np.abs(away - border), least[open_]
        beyond = np.maximum(least, gap)
        # First the side a query lies in, then, with what that found, the other.
        yield from self._walk(near, queries, which[inside], least[inside], best, factor)
        yield from self._walk(far, queries, which[~inside], least[~inside], best, factor)
        yield from self._walk(far, queries, which[inside], beyond[inside], best, factor)
        yield from self._walk(near, queries, which[~inside], beyond[~inside], best, factor)


def dots(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, so equal rows score equal."""
    total = np.zeros(len(rows))
    for j in range(len(query)):
        total += rows[:, j] * query[j]
    return total


def nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, how: Search):
    """(query, id, score) rows: the k best of *vectors* found for each query."""
    norms = (vectors**2).sum(axis=1)
    top = norms.max()
    lifted = np.hstack([vectors, np.sqrt(np.maximum(top - norms, 0.0))[:, None]])
    asked = np.hstack([queries, np.zeros((len(queries), 1))])
    lengths = (queries**2).sum(axis=1) + top
    tree = Tree(lifted, how.leaf, how.seed)
    k = how.k
    kept = np.full((len(queries), k), -np.inf)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(queries))]

    def best(which: np.ndarray) -> np.ndarray:
        worst = kept[which, 0]
        return np.sqrt(np.maximum(lengths[which] - 2 * worst, 0.0)) * (1 + 1e-9) + 1e-9

    for rows, which in tree.leaves(asked, best, how.factor):
        products = queries[which] @ vectors[rows].T
        products[query_ids[which][:, None] == ids[rows][None, :]] = -np.inf
        slack = 1e-9 * (1.0 + np.abs(lengths[which]))
        hits = products >= (kept[which, 0] - slack)[:, None]
        hits &= np.isfinite(products)
        merged = np.concatenate([kept[which], products], axis=1)
        kept[which] = np.sort(np.partition(merged, -k, axis=1)[:, -k:], axis=1)
        for i, q in enumerate(which.tolist()):
            if hits[i].any():
                found[q].append((rows[hits[i]], products[i][hits[i]]))
    out = []
    for q, parts in enumerate(found):
        if not parts:
            continue
        rows = np.concatenate([r for r, _ in parts])
        rough = np.concatenate([p for _, p in parts])
        rows = rows[rough >= kept[q, 0] - 1e-9 * (1.0 + abs(lengths[q]))]
        score = dots(queries[q], vectors[rows])
        order = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(order), query_ids[q]), ids[rows][order], score[order]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out))


RESULT = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("vec_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def neighbours(
    table: DataFrame, is_query, how: Search = Search(), *, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the *k* nearest found for each row for which *is_query* holds."""
    rows = usable(table, key, vector)
    asked = rows.filter(is_query(F.col("id")))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(is_query(F.col("id")).cast("long")).alias("q")).first()
    shards = max(1, -(-sizes["n"] // how.shard_rows))
    blocks = max(1, -(-(sizes["q"] or 0) // how.block_rows))
    # Dealt by hash; a key of (shard, block) is a bounded number of rows.
    shard = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("dim", "id", "v", shard.alias("shard"), every(blocks).alias("block"))
    queries = asked.select("dim", "id", "v", block.alias("block"), every(shards).alias("shard"))
    keys = ["dim", "shard", "block"]

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        left = left.sort_values("id", kind="stable")
        found = nearest(
            left["id"].to_numpy(), np.stack(left["v"].to_numpy()), right["id"].to_numpy(), np.stack(right["v"].to_numpy()), how
        )
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    met = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(pair, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = materialise(met, "nearest").withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= how.k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
