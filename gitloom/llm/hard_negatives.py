"""Hard negatives by integer inner product, found with angular triangle filtering.

Every component x becomes floor(scale * x). Each shard picks reference directions among its own rows,
the first the longest row, each next one farthest from those before, and stores the angle of every
row to each. For an anchor at angle b to a reference and a row at angle a, the angle between the two
lies from |a - b| to min(a + b, 2 pi - a - b). The narrowest interval over the references, as
cosines times both norms, bounds the score; bounds are widened by more than rounding can take, so a
row is dropped only if its exact score cannot matter.

First every anchor's positives are looked up: rows of its label, scored in the order of their upper
bounds until no bound reaches the k-th score. Then each positive opens a window of scores. The
angles sorted per reference cut a shard to the rows that can reach the lowest window; what remains
is scored only if its interval overlaps a window, with integers, and the best of each window stay.
Shards are merged per anchor, then per anchor and positive.

Rows with a NULL id, label or vector, or with a NULL or non-finite component take no part. Zero
vectors do and score 0. Vectors of different dimension are never compared. Rows with the anchor's own
id are not its positives. A repeated row counts each time, as positive and as negative; anchors equal
in id, label and vector are mined once, others that share an id each on its own, and equal positives
each have their own window. Ties go to the smaller id. Fewer rows than asked for: all of them; a
window of a negative positive score is empty. Components and scores saturate at the ends of a long.
Other columns are not read, whatever their names. Empty table: empty result.
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

# Radians, and a share of the norms' product: far above what rounding takes from angles and bounds.
ANGLE_SLACK = 1e-6
SCORE_SLACK = 1e-9


@dataclass(frozen=True)
class Mining:
    """A negative's score lies from *low_percent* to 100 percent of the positive's."""

    positives: int = 5
    negatives: int = 5
    low_percent: int = 80
    scale: float = 256.0
    references: int = 8
    first_scored: int = 64
    layout: Layout = field(default_factory=Layout)

    def window(self, positive: int) -> tuple[int, int]:
        return -(-self.low_percent * positive // 100), positive


def _angles(directions: np.ndarray, points: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Angles of each direction (unit) to each point; a right angle to zero vectors."""
    cosines = directions @ points.T / np.where(norms > 0, norms, 1.0)
    return np.arccos(np.clip(cosines, -1.0, 1.0))


class Angles:
    """One shard's rows with their angles to the shard's references."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, how: Mining):
        self.ids, self.labels, self.points, self.how = ids, labels, points, how
        self.values = points.astype(float)
        self.norms = np.sqrt((self.values**2).sum(axis=1))
        self.longest = float(self.norms.max())
        self.largest = float(np.abs(self.values).max(initial=0.0))
        order = np.argsort(labels, kind="stable")
        cuts = np.flatnonzero(np.diff(labels[order])) + 1
        self.by_label = {int(labels[rows[0]]): rows for rows in np.split(order, cuts)}
        self.directions = self._references()
        self.angles = _angles(self.directions, self.values, self.norms)
        self.order = np.argsort(self.angles, axis=1)
        self.sorted = np.take_along_axis(self.angles, self.order, axis=1)

    def _references(self) -> np.ndarray:
        chosen, nearest, at = [], np.full(len(self.ids), np.inf), int(np.argmax(self.norms))
        while len(chosen) < self.how.references and self.norms[at] > 0 and nearest[at] > ANGLE_SLACK:
            chosen.append(self.values[at] / self.norms[at])
            nearest = np.minimum(nearest, _angles(chosen[-1][None], self.values, self.norms)[0])
            at = int(np.argmax(np.where(self.norms > 0, nearest, -1.0)))
        return np.array(chosen).reshape(len(chosen), self.values.shape[1])

    def anchor(self, vector: np.ndarray) -> "Anchor":
        return Anchor(self, vector)


class Anchor:
    """One anchor as a shard sees it."""

    def __init__(self, shard: Angles, vector: np.ndarray):
        self.shard, self.vector, self.value = shard, vector, vector.astype(float)
        self.norm = float(np.sqrt((self.value**2).sum()))
        self.angles = _angles(shard.directions, self.value[None], np.array([self.norm]))[:, 0]
        self.exact = float(np.abs(self.value).sum()) * shard.largest < EXACT

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.exact:
            return self.shard.values[rows] @ self.value
        return large_products(self.shard.points[rows], self.vector)

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest score each row may have."""
        if not self.exact:
            return np.full(len(rows), -np.inf), np.full(len(rows), np.inf)
        least, most = np.zeros(len(rows)), np.full(len(rows), np.pi)
        for own, angles in zip(self.angles, self.shard.angles):
            a = angles[rows]
            np.maximum(least, np.abs(a - own), out=least)
            np.minimum(most, np.minimum(a + own, 2 * np.pi - a - own), out=most)
        scale = self.norm * self.shard.norms[rows]
        slack = SCORE_SLACK * scale + 1.0
        high = scale * np.cos(np.maximum(least - ANGLE_SLACK, 0.0)) + slack
        return scale * np.cos(np.minimum(most + ANGLE_SLACK, np.pi)) - slack, high

    def reaching(self, need: int) -> np.ndarray:
        """Rows whose angle to the reference that cuts most leaves room for a score of *need*."""
        shard, reach = self.shard, self.norm * self.shard.longest
        if need <= 0 or not self.exact:
            return np.arange(len(shard.ids))
        if need > reach * (1 + SCORE_SLACK):
            return np.empty(0, int)
        wide = float(np.arccos(min(1.0, need / reach))) + 2 * ANGLE_SLACK
        slices = [
            (np.searchsorted(row, own - wide), np.searchsorted(row, own + wide, side="right"))
            for own, row in zip(self.angles, shard.sorted)
        ]
        if not slices:
            return np.arange(len(shard.ids))
        i = min(range(len(slices)), key=lambda i: slices[i][1] - slices[i][0])
        return shard.order[i][slice(*slices[i])]

    def positives(self, own: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows of the label."""
        shard = self.shard
        rows = shard.by_label.get(label, np.empty(0, int))
        rows = rows[shard.ids[rows] != own]
        high = self.bounds(rows)[1]
        order = np.argsort(-high, kind="stable")
        tried = order[: max(k, shard.how.first_scored)]
        rest = order[len(tried) :]
        scores = self.scores(rows[tried])
        if len(rest):
            kth = np.sort(scores)[-k]
            rest = rest[high[rest] >= kth]
            tried, scores = np.concatenate([tried, rest]), np.concatenate([scores, self.scores(rows[rest])])
        chosen = first(scores, shard.ids[rows[tried]], k)
        return shard.ids[rows[tried[chosen]]], as_long(scores[chosen])

    def negatives(self, label: int, positive_scores: list[int], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per positive, (ids, scores) of the k best rows of other labels in its window."""
        shard, how = self.shard, self.shard.how
        windows = [how.window(score) for score in positive_scores]
        open_ = [(low, high) for low, high in windows if low <= high]
        if not open_:
            return [(shard.ids[:0], shard.ids[:0])] * len(windows)
        rows = self.reaching(min(low for low, _ in open_))
        rows = rows[shard.labels[rows] != label]
        least, most = self.bounds(rows)
        overlap = np.zeros(len(rows), bool)
        for low, high in open_:
            overlap |= (most >= low) & (least <= high)
        rows = rows[overlap]
        scores = self.scores(rows)
        found = []
        for low, high in windows:
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            chosen = inside[first(scores[inside], shard.ids[rows[inside]], k)]
            found.append((shard.ids[rows[chosen]], as_long(scores[chosen])))
        return found


def _schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


POSITIVES = _schema("anchor_id", "ask", "positive_id", "positive_score")
NEGATIVES = _schema("anchor_id", "ask", "nth", "positive_id", "positive_score", "negative_id", "negative_score")


def _columns(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    """Rows given as (single values…, two arrays of equal length) as one batch."""
    counts = [len(r[-1]) for r in rows]
    single = [np.repeat(np.array([r[i] for r in rows], np.int64), counts) for i in range(len(schema) - 2)]
    pairs = [np.concatenate([np.empty(0, np.int64), *[r[i] for r in rows]]) for i in (-2, -1)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (*single, *pairs)], schema.names)


def mined(
    table: DataFrame,
    is_anchor,
    how: Mining = Mining(),
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows for which *is_anchor* holds."""
    named = F.col(f"`{label}`").cast("long").alias("label")
    rows = materialise(whole_numbers(table, key, vector, how.scale, named).filter("label IS NOT NULL"), "labelled-vectors")
    anchors = materialise(distinct_queries(rows, is_anchor(F.col("id"))), "anchors")

    def build(batch: pa.RecordBatch, dim: int) -> Angles:
        return Angles(batch.column("id").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("v"), dim), how)

    def told(batch: pa.RecordBatch, dim: int):
        columns = [batch.column(c).to_numpy() for c in ("id", "ask", "label")]
        return zip(*columns, matrix(batch.column("v"), dim))

    def likes(shard: Angles, batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
        found = [
            (own, ask, *shard.anchor(v).positives(own, int(label), how.positives)) for own, ask, label, v in told(batch, dim)
        ]
        return _columns(found, POSITIVES)

    best = Window.partitionBy("anchor_id", "ask").orderBy(F.col("positive_score").desc(), "positive_id")
    ranked = meet(rows, anchors, build, likes, POSITIVES, how.layout).withColumn("nth", F.row_number().over(best))
    # At most *positives* of an anchor are left to be listed.
    windows = (
        ranked.filter(F.col("nth") <= how.positives)
        .groupBy(F.col("anchor_id").alias("id"), "ask")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("windows"))
    )
    opened = materialise(anchors.join(windows, ["id", "ask"]), "anchor-windows")

    def unlikes(shard: Angles, batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
        found = []
        for (own, ask, label, v), given in zip(told(batch, dim), batch.column("windows").to_pylist()):
            each = shard.anchor(v).negatives(int(label), [w["positive_score"] for w in given], how.negatives)
            found += [(own, ask, w["nth"], w["positive_id"], w["positive_score"], *pair) for w, pair in zip(given, each)]
        return _columns(found, NEGATIVES)

    order = Window.partitionBy("anchor_id", "ask", "nth").orderBy(F.col("negative_score").desc(), "negative_id")
    met = meet(rows, opened, build, unlikes, NEGATIVES, how.layout).withColumn("rank", F.row_number().over(order))
    kept = met.filter(F.col("rank") <= how.negatives)
    return kept.select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score"
    )
