"""Importance resampling towards a target distribution: hashed n-gram gains and a distributed quickselect.

A text's features are its runs of one to three words, hashed into buckets by crc32. Two passes of
counting give every bucket's share among the documents and among the target's texts; the gain of a
bucket is the floored logarithm of their smoothed ratio. The gains are one array of *buckets*
numbers, whatever the corpus holds; a document's weight is the sum of the array at its features.
Weight and Gumbel noise from the document's id make its score, so the highest scores are a draw
without replacement.

The scores are written once, each with a unique key (score descending, doc_id, row). The k-th key
is found by quickselect: rounds pick random pivot keys inside the open interval, count exactly how
many keys lie below, at and above each, and go on in the interval that holds place k. A round is a
filtered scan, a sample of a fixed size and one count; no row moves and no task sorts. Rows up to
the k-th key are the winners; only they are ordered, by range, and ranked.

NULL and empty texts have no features and weight 0. A NULL doc_id is an empty text in the noise and
comes after all others in ties; rows equal in score and doc_id are drawn in the order of their place
in the written scores, each repeated row on its own. Long texts are cut between words into pieces
that share their edge words, so no list is longer than a piece. Fewer candidates than needed for one
draw: no rank. An empty target still gives gains (its counts are zero). Other columns are not read,
whatever their names. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gitloom.llm.common import texts
from gitloom.operators.sequence import SEQ, ordered
from gitloom.session import materialise

# Words are digits, letters and everything beyond ASCII; A-Z become a-z.
FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


@dataclass(frozen=True)
class Draw:
    """share_percent of the texts with at least least_words words are drawn."""

    share_percent: int = 5
    least_words: int = 20
    buckets: int = 10_000
    seed: int = 42
    pivots: int = 31
    piece: int = 1 << 20


def _pieces(text: bytes, piece: int) -> Iterator[list[bytes]]:
    """Words of the text in lists; each list starts with the last two words of the one before."""
    folded, at, last = text.translate(FOLD), 0, []
    while at < len(folded):
        end = at + piece
        if end < len(folded):
            end = folded.find(b" ", end)
            end = len(folded) if end < 0 else end
        words = folded[at:end].split()
        at = end
        if words:
            yield last + words
            last = (last + words)[-2:]


def hashed(text: bytes, buckets: int, piece: int) -> tuple[np.ndarray, int]:
    """(the bucket of every feature, number of words)."""
    found, n_words, known = [], 0, 0
    for words in _pieces(text, piece):
        spaced = [b" " + w for w in words]
        # crc32 goes on from a prefix: a run's hash is its head's, carried over the next word.
        one = list(map(crc32, words))
        two = list(map(crc32, spaced[1:], one))
        three = list(map(crc32, spaced[2:], two))
        # Runs within the shared words were told before.
        found += [one[known:], two[max(0, known - 1) :], three]
        n_words += len(words) - known
        known = min(2, n_words)
    each = [np.array(f, dtype=np.int64) for f in found]
    return (np.concatenate(each) % buckets if each else np.empty(0, np.int64)), n_words


def bucket_counts(docs: DataFrame, text: str, how: Draw) -> list[int]:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(how.buckets, np.int64)
        for batch in batches:
            for value in texts(batch.column(0)):
                np.add.at(total, hashed(value, how.buckets, how.piece)[0], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = docs.select(F.col(f"`{text}`")).mapInArrow(run, "bucket long, n long")
    out = [0] * how.buckets
    # One row per bucket at most.
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Per bucket, a thousand times the logarithm of target share over source share, floored."""
    n, s, t = len(source), sum(source), sum(target)
    return [
        math.floor(1000 * math.log(float((b + 1) * (s + n)) / float((a + 1) * (t + n)))) for a, b in zip(source, target)
    ]


def noise(seed: int, doc_id: int | None) -> int:
    """A thousandfold Gumbel variate, floored, fixed by the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_features", T.LongType()),
        T.StructField("weight", T.LongType()),
        T.StructField("score", T.LongType()),
    ]
)


def scored(docs: DataFrame, table: list[int], how: Draw, key: str = "doc_id", text: str = "text") -> DataFrame:
    """SCORED per document, by the array of gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(table, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for doc_id, value in zip(ids, texts(batch.column(1))):
                found, n_words = hashed(value, how.buckets, how.piece)
                weight = int(gain[found].sum())
                rows.append((n_words, len(found), weight, weight + noise(how.seed, doc_id)))
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=pa.int64()) for c in (ids, *columns)], SCORED.names
            )

    return docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")).mapInArrow(run, SCORED)


# Best first: highest score, then smallest doc_id, NULL last, then the row's place.
KEY = ("down", "unnamed", "doc", "row")


def _keyed(frame: DataFrame) -> DataFrame:
    return frame.select(
        "*",
        (-F.col("score")).alias("down"),
        F.col("doc_id").isNull().cast("int").alias("unnamed"),
        F.coalesce("doc_id", F.lit(0)).alias("doc"),
    )


def _literal(key: tuple) -> Column:
    kinds = ("long", "int", "long", "long")
    return F.struct(*[F.lit(v).cast(kind).alias(name) for v, kind, name in zip(key, kinds, KEY)])


def kth_key(keyed: DataFrame, k: int, pivots: int, seed: int) -> tuple | None:
    """The k-th smallest of the unique keys; None where there are fewer than k."""
    key, low, high, before, turn = F.struct(*KEY), None, None, 0, 0
    while True:
        # The score alone as well: by that the scan can skip.
        within = keyed
        if low is not None:
            within = within.filter((F.col("down") >= low[0]) & (key > _literal(low)))
        if high is not None:
            within = within.filter((F.col("down") <= high[0]) & (key < _literal(high)))
        random = F.xxhash64("row", F.lit(seed), F.lit(turn))
        chosen = sorted(tuple(r) for r in within.orderBy(random, "row").limit(pivots).select(*KEY).collect())
        if not chosen:
            return None
        # A key's place among the pivots: twice the pivots below it, and one more where it is a pivot.
        table = F.array(*[_literal(p) for p in chosen])
        place = F.aggregate(
            table, F.lit(0), lambda n, p: n + F.when(p < key, 2).when(p == key, 1).otherwise(0)
        )
        counts = {r["place"]: r["count"] for r in within.groupBy(place.alias("place")).count().collect()}
        for i in range(2 * len(chosen) + 1):
            if before + counts.get(i, 0) >= k:
                break
            before += counts.get(i, 0)
        else:
            return None
        if i % 2:
            return chosen[i // 2]
        low = chosen[i // 2 - 1] if i else low
        high = chosen[i // 2] if i // 2 < len(chosen) else high
        turn += 1


def resampled(
    docs: DataFrame, target: DataFrame, how: Draw = Draw(), *, key: str = "doc_id", text: str = "text", target_text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): every document, ranked where it is drawn."""
    table = gains(bucket_counts(docs, text, how), bucket_counts(target, target_text, how))
    placed = scored(docs, table, how, key, text).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(_keyed(placed), "scores")
    able = rows.filter(F.col("n_words") >= how.least_words)
    k = how.share_percent * able.count() // 100
    out = [*SCORED.names]
    last = kth_key(able, k, how.pivots, how.seed) if k else None
    if last is None:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    won = (F.col("n_words") >= how.least_words) & (F.struct(*KEY) <= _literal(last))
    winners = ordered(rows.filter((F.col("down") <= F.lit(last[0])) & won), list(KEY)).frame
    rest = rows.filter(~won).select(*out, F.lit(None).cast("long").alias("rank"))
    return winners.select(*out, F.col(SEQ).cast("long").alias("rank")).unionByName(rest)
