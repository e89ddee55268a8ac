"""Toxic passages by maximum-scoring segment search.

Each word scores by its log odds of standing in a toxic and in a clean labelled text, with a
Dirichlet prior that follows the word's overall rate. A word is also looked at by its first
letters, as unseen forms share their root with seen ones; of these features the most certain one
speaks (by likelihood ratio), and none does that chance explains. Less a constant drift, a clean text sums to something negative,
and a linear scan (after Ruzzo and Tompa) finds all maximal segments: the passages.

By extreme-value theory a segment of score S turns up by chance in a clean text of n words about
K n exp(-lambda S) times. What a segment has beyond that, lambda S - ln(K n), is its evidence; a
text's evidence is the sum over its significant segments, and a logistic curve, fitted on labelled
texts apart from those that gave its counts, turns it into a probability. The counts of all
labelled texts then make the final model.

Learning reads at most about ``most_labelled`` labelled texts, chosen by a hash of the id: a bound
on the rows that are broadcast, not on the rows scored. Features are counted in ``1 << feature_bits``
hashed cells, so the model's size is fixed. Every text is scored whole, without a shuffle.

NULL and empty texts have no evidence and get the score of a text without any. NULL labels are
left out; a document labelled twice counts as toxic if any label says so; a label without a
document is left out. Without labels of both kinds every score is 0. Repeated rows score alike; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gitloom.llm.common import ROW, add_columns, texts

EDGES = ".,;:!?\"'()[]{}<>*#-_"
CACHE = 400_000


@dataclass(frozen=True)
class Settings:
    most_labelled: int = 100_000
    feature_bits: int = 19
    prefixes: tuple[int, ...] = (3, 4, 5, 6)
    prior_texts: float = 10.0
    # How certain a feature has to be to speak: the signed root of its likelihood ratio statistic.
    sure: float = 4.0
    drift: float = 0.3
    most_score: float = 6.0


@dataclass
class Model:
    settings: Settings
    odds: np.ndarray
    certain: np.ndarray
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 0.0
    bias: float = -30.0


def word_list(data: bytes) -> list[str]:
    return data.decode("utf-8", "replace").lower().split()


def cells(word: str, settings: Settings) -> list[int]:
    bare = word.strip(EDGES) or word
    mask = (1 << settings.feature_bits) - 1
    found = [zlib.crc32(b"w" + bare.encode("utf-8", "replace")) & mask]
    for n in settings.prefixes:
        if len(bare) >= n:
            found.append(zlib.crc32(b"%d" % n + bare[:n].encode("utf-8", "replace")) & mask)
    return found


class Scorer:
    """Scores words with one model, remembering those seen lately."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}

    def word(self, word: str) -> float:
        at = cells(word, self.model.settings)
        s = self.model.settings
        best = at[int(np.argmax(self.model.certain[at]))]
        odds = float(self.model.odds[best]) if self.model.certain[best] >= s.sure else 0.0
        return max(-s.most_score, min(s.most_score, odds)) - s.drift

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.seen) > CACHE:
            self.seen.clear()
        seen = self.seen
        for w in set(words):
            if w not in seen:
                seen[w] = self.word(w)
        return np.fromiter(map(seen.__getitem__, words), np.float64, len(words))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, end, score), in linear time.

    Only words above zero can begin or end one, so the words between two of them are one step.
    """
    ups = np.flatnonzero(scores > 0)
    if not len(ups):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    # Each: first, end, sum before it, sum after it, and the nearest one before with a smaller left sum.
    stack: list[list] = []
    for i in ups.tolist():
        item = [i, i + 1, float(total[i]), float(total[i + 1])]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= item[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= item[3]:
                stack.append([*item, j])
                break
            item = [stack[j][0], item[1], stack[j][2], item[3]]
            del stack[j:]
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def evidence(model: Model, scorer: Scorer, data: bytes) -> tuple[float, list[tuple[int, int, float, float]]]:
    """The text's evidence, and its significant segments as (first word, end, score, chance)."""
    words = word_list(data)
    if not words:
        return 0.0, []
    total, passages = 0.0, []
    for first, end, score in segments(scorer.scores(words)):
        beyond = model.rate * score - math.log(max(model.scale * len(words), 1e-9))
        if beyond > 0:
            total += beyond
            passages.append((first, end, score, 1.0 - math.exp(-math.exp(-beyond))))
    return total, passages


def _labelled(docs: DataFrame, labels: DataFrame, train: Column, settings: Settings, text: str, key: str, label: str):
    """(text, toxic, fold) of the labelled texts that may be learned from."""
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & train)
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(label).alias("toxic"))
    )
    hashed = F.pmod(F.xxhash64("_key"), F.lit(1 << 20))
    n = max(known.count(), 1)
    bound = min(1 << 20, settings.most_labelled * (1 << 20) // n)
    chosen = known.filter(hashed < bound).withColumn("fold", F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(3)))
    slim = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    return slim.join(F.broadcast(chosen), "_key").select("_text", "toxic", "fold")


COUNTS = ("toxic", "clean", "held_toxic", "held_clean")


def _counted(rows: DataFrame, settings: Settings) -> DataFrame:
    """(cell, counts): in how many texts of each kind a feature stands, those for the curve apart."""
    size = 1 << settings.feature_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((4, size + 1), dtype=np.int64)
        memory: dict[str, list[int]] = {}
        for batch in batches:
            kinds = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            for data, (toxic, fold) in zip(texts(batch.column(0)), kinds):
                if len(memory) > CACHE:
                    memory.clear()
                found = {size}  # the last cell counts the texts
                for w in set(word_list(data)):
                    at = memory.get(w)
                    if at is None:
                        at = memory[w] = cells(w, settings)
                    found.update(at)
                kind = (0 if toxic > 0 else 1) + (2 if fold == 2 else 0)
                counts[kind][np.fromiter(found, np.int64, len(found))] += 1
        held = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(held), *[pa.array(c[held]) for c in counts]], ["cell", *COUNTS])

    schema = ", ".join(f"{c} long" for c in ("cell", *COUNTS))
    found = rows.select("_text", "toxic", "fold").mapInArrow(run, schema)
    return found.groupBy("cell").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _odds(counts: np.ndarray, settings: Settings) -> Model:
    n1, n0 = counts[:, -1].astype(np.float64)
    toxic, clean = counts[:, :-1].astype(np.float64)
    both, texts_seen = toxic + clean, max(n1 + n0, 1.0)
    prior = settings.prior_texts * both / texts_seen
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log((toxic + prior) / (n1 + settings.prior_texts)) - np.log(
            (clean + prior) / (n0 + settings.prior_texts)
        )
        parts = [
            np.where(seen > 0, seen * np.log(seen * texts_seen / (row * column)), 0.0)
            for seen, row, column in (
                (toxic, both, n1),
                (clean, both, n0),
                (n1 - toxic, texts_seen - both, n1),
                (n0 - clean, texts_seen - both, n0),
            )
        ]
    certain = np.sqrt(np.maximum(2 * sum(parts), 0.0))
    odds[both == 0] = 0.0
    return Model(settings, odds.astype(np.float32), np.nan_to_num(certain).astype(np.float32))


def _scan(rows: DataFrame, model: Model) -> DataFrame:
    """(toxic, words, largest segment, evidence, sum of the scores' exponentials) of labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = []
            for data, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                scores = scorer.scores(word_list(data))
                parts = segments(scores)
                found.append((int(toxic > 0), len(scores), [p[2] for p in parts]))
            columns = list(zip(*found)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.list_(pa.float64())),
                ],
                ["toxic", "words", "parts"],
            )

    return rows.select("_text", "toxic").mapInArrow(run, "toxic long, words long, parts array<double>")


def _calibrated(model: Model, seen: list) -> Model:
    """Fit the extreme-value law on the clean texts, then the curve on all of them."""
    best = np.array([max(r["parts"], default=0.0) for r in seen])
    words = np.array([max(r["words"], 1) for r in seen], dtype=np.float64)
    toxic = np.array([r["toxic"] for r in seen], dtype=np.float64)
    clean = toxic == 0
    # Largest scores of clean texts, less the part that grows with length, follow a Gumbel law.
    spread = max(float(np.std(best[clean])), 0.3)
    for _ in range(20):
        model.rate = math.pi / (math.sqrt(6) * spread)
        level = best[clean] - np.log(words[clean]) / model.rate
        spread = 0.5 * spread + 0.5 * max(float(np.std(level)), 0.3)
    model.scale = math.exp(model.rate * float(np.mean(level)) - 0.5772156649)
    total = np.array(
        [
            sum(max(0.0, model.rate * s - math.log(max(model.scale * n, 1e-9))) for s in r["parts"])
            for r, n in zip(seen, words)
        ]
    )
    x = np.log1p(total)
    design = np.stack([x, np.ones_like(x)], axis=1)
    weights = np.zeros(2)
    ridge = np.diag([0.01, 0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (toxic - p) - ridge @ weights
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.bias = max(float(weights[0]), 0.0), float(weights[1])
    return model


def learned(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    settings: Settings = Settings(),
    *,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
) -> Model:
    """A model from the labels for which *train* holds."""
    rows = _labelled(docs, labels, train, settings, text, key, label)
    counts = np.zeros((4, (1 << settings.feature_bits) + 1), dtype=np.int64)
    # One row per hashed cell at most, whatever the corpus.
    found = _counted(rows, settings).toPandas()
    for into, name in zip(counts, COUNTS):
        into[found["cell"]] = found[name]
    model = _odds(counts[:2], settings)
    # Two numbers and the segments of each sampled text.
    seen = _scan(rows.filter("fold = 2"), model).collect()
    kinds = {r["toxic"] for r in seen}
    if len(kinds) < 2 or not counts[0].any() or not counts[1].any():
        return model
    whole = _odds(counts[:2] + counts[2:], settings)
    return replace(_calibrated(model, seen), odds=whole.odds, certain=whole.certain)


PASSAGES = T.ArrayType(
    T.StructType(
        [
            T.StructField("first_word", T.LongType()),
            T.StructField("end_word", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("chance", T.DoubleType()),
        ]
    )
)
ADDED = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("evidence", T.DoubleType()),
        T.StructField("passages", PASSAGES),
    ]
)


def probability(model: Model, total: float) -> float:
    if model.slope == 0.0 and model.bias == -30.0:
        return 0.0
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, model.slope * math.log1p(total) + model.bias))))


def scored(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """(_row, score, evidence, passages) for every row of *docs*."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(
        pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())])
    )

    def make(values: list[bytes]) -> list[pa.Array]:
        scorer = _scorer(shared)
        found = [evidence(scorer.model, scorer, v) for v in values]
        return [
            pa.array([probability(scorer.model, e) for e, _ in found], pa.float64()),
            pa.array([e for e, _ in found], pa.float64()),
            pa.array([[dict(zip(("first_word", "end_word", "score", "chance"), p)) for p in ps] for _, ps in found], kind),
        ]

    return add_columns(docs, text, ADDED, make)


_SCORERS: dict = {}


def _scorer(shared) -> Scorer:
    """One scorer per worker and model: its memory of words outlives a batch."""
    model = shared.value
    if id(model) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(model)] = Scorer(model)
    return _SCORERS[id(model)]
