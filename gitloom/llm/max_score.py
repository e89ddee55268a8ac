"""Exact top-k search by integer inner product, with MaxScore.

Every component x becomes floor(scale * x). A vector is read as a document over signed terms: term
(j, +) holds its positive component j, term (j, -) its negative one. A shard keeps, per signed term,
a posting bitmap, the largest magnitude, and the rows of the largest magnitudes (the list's head).

A query helps itself along the terms of its own signs; component j adds at most |q_j| times the
list's largest magnitude. The heads of its strongest terms give a first k-th score. Terms are split
there: the weakest ones whose bounds together stay below that score are non-essential, since a row
in none of the other, essential lists cannot reach it. Essential postings are traversed; the rows
found are then probed in the non-essential terms, strongest first, and only while what they have
plus the bounds left can still reach the k-th score. Each shard gives its k best; they are merged
per query. Nothing is approximate: rows are dropped on strict bounds only.

NULL ids, NULL vectors and vectors with a NULL or non-finite component take no part; zero vectors do
and score 0; empty vectors meet empty vectors, with score 0. Vectors of different dimension are never
compared. Rows with the query's own id are left out. A repeated row is a candidate each time; queries
equal in id and vector are answered once, those that share an id but not the vector each on its own.
Ties go to the smaller id. Fewer candidates than k: all of them. Components and scores saturate at
the ends of a long. Other columns of the table are not read, whatever their names. Empty table: empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gitloom.llm.blocks import EXACT, Layout, as_long, distinct_queries, first, large_products, matrix, meet, whole_numbers
from gitloom.session import materialise


@dataclass(frozen=True)
class Search:
    """heads: rows kept per list; seeds: strongest terms whose heads are tried; step: terms probed between two cuts."""

    k: int = 5
    scale: float = 256.0
    heads: int = 16
    seeds: int = 16
    step: int = 4
    layout: Layout = field(default_factory=Layout)


class Postings:
    """One shard's signed terms."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, how: Search):
        self.ids, self.points, self.how = ids, points, how
        self.values = np.ascontiguousarray(points.T, dtype=float)
        dim, n = self.values.shape
        self.most = np.stack([self.values.max(axis=1), -self.values.min(axis=1)]).clip(0)
        self.bits = np.packbits(np.stack([self.values > 0, self.values < 0]), axis=-1)
        few = min(how.heads, n)
        order = np.argpartition(self.values, (few - 1, n - few), axis=1) if dim else np.empty((0, n), int)
        self.heads = np.stack([order[:, n - few :], order[:, :few]])
        self.every = np.arange(n)

    def _enough(self, query: np.ndarray, lists: tuple[np.ndarray, np.ndarray], own: int) -> float:
        """The k-th best score among the heads of some lists; minus infinity where they hold fewer rows."""
        rows = np.unique(self.heads[lists])
        rows = rows[self.ids[rows] != own]
        if len(rows) < self.how.k:
            return -np.inf
        scores = query @ self.values[:, rows]
        return float(np.partition(scores, len(rows) - self.how.k)[len(rows) - self.how.k])

    def best(self, own: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows."""
        query = asked.astype(float)
        sign = (query < 0).astype(int)
        bound = np.abs(query) * self.most[sign, np.arange(len(query))]
        if np.abs(query) @ self.most.max(axis=0) >= EXACT:
            rows, scores = self.every, large_products(self.points, asked)
        else:
            rows, scores = self._competitive(query, sign, bound, own)
        other = self.ids[rows] != own
        rows, scores = rows[other], scores[other]
        chosen = first(scores, self.ids[rows], self.how.k)
        return self.ids[rows[chosen]], as_long(scores[chosen])

    def _competitive(self, query, sign, bound, own) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best, with their whole scores."""
        weakest_first = np.argsort(bound, kind="stable")
        strongest = weakest_first[len(query) - self.how.seeds :] if len(query) > self.how.seeds else weakest_first
        least = self._enough(query, (sign[strongest], strongest), own)
        if least <= 0:  # rows without any term of the query may be among the best
            return self.every, query @ self.values
        together = np.cumsum(bound[weakest_first])
        spare = int(np.searchsorted(together, least, side="left"))
        essential = weakest_first[spare:]
        rows = self._in_any(sign[essential], essential)
        scores = (query[essential] @ self.values[essential])[rows]
        while spare:
            hopeful = scores + together[spare - 1] >= least
            rows, scores = rows[hopeful], scores[hopeful]
            probed = weakest_first[max(0, spare - self.how.step) : spare]
            scores = scores + query[probed] @ self.values[np.ix_(probed, rows)]
            spare -= len(probed)
        return rows, scores

    def _in_any(self, signs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Rows that hold at least one of the signed terms."""
        if not len(terms):
            return np.empty(0, int)
        met = np.bitwise_or.reduce(self.bits[signs, terms], axis=0)
        return np.flatnonzero(np.unpackbits(met, count=len(self.ids)))


RESULT = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("ask", T.LongType()),
        T.StructField("vec_id", T.LongType()),
        T.StructField("score", T.LongType()),
    ]
)


def top(table: DataFrame, is_query, how: Search = Search(), *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the *k* best rows for each row for which *is_query* holds."""
    rows = materialise(whole_numbers(table, key, vector, how.scale), "whole-vectors")
    asked = materialise(distinct_queries(rows, is_query(F.col("id"))), "asked-vectors")

    def build(batch: pa.RecordBatch, dim: int) -> Postings:
        return Postings(batch.column("id").to_numpy(), matrix(batch.column("v"), dim), how)

    def answer(index: Postings, batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
        ids, asks = batch.column("id").to_numpy(), batch.column("ask").to_numpy()
        found = [index.best(own, query) for own, query in zip(ids, matrix(batch.column("v"), dim))]
        counts = [len(scores) for _, scores in found]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(ids, counts)),
                pa.array(np.repeat(asks, counts)),
                pa.array(np.concatenate([i for i, _ in found])),
                pa.array(np.concatenate([s for _, s in found])),
            ],
            RESULT.names,
        )

    met = meet(rows, asked, build, answer, RESULT, how.layout)
    best = Window.partitionBy("query_id", "ask").orderBy(F.col("score").desc(), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= how.k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
