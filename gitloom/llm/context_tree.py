"""Scoring texts with context-tree weighting.

A text is its bytes, A-Z in lower case, and an end. A byte is eight binary decisions; each decision
has a tree over the bytes before it, up to ``depth`` of them. At every node of a tree a
Krichevsky-Trofimov estimate from the training counts competes with the mixture of what lies
deeper; both get half the weight beforehand, so the data decide how much context counts. Counts
come from all training texts; scoring uses them as they are. The predictions of a node add up to
one, so the score is the log probability of the text under one proper model.

Texts are dealt over blocks of some thousand. A block sends its distinct (context, byte) strings
with their counts to the places that hold the parts of the tree, by the two latest bytes; a place
builds everything below those, the two top levels (at most 65,280 nodes whatever the corpus) are
summed over the places, and each block gets the probabilities of just the strings that it asked
for. Nothing of the model but its two top levels is ever whole anywhere, and no count is cut.

The same way, a base score from word frequencies with additive smoothing.

NULL and empty texts are an end alone. No training text: every decision is 1/2. Repeated rows score
alike and count each. NULL ids count by the caller's rule. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitloom.llm.common import LOWER
from gitloom.llm.packed import by_place, expanded, groups, plain, squeezed, summed, unplain
from gitloom.session import materialise

START, STOP = 0xFE, 0xFF
SLICE = 1 << 22
CACHE = 400_000
HALF = math.log(0.5)


@dataclass(frozen=True)
class Model:
    depth: int = 5
    docs_per_block: int = 12_000
    smoothing: float = 0.1


def strings(stream: np.ndarray, depth: int) -> np.ndarray:
    """For each byte of *stream* from *depth* on: the bytes before it, latest first, and itself."""
    last = len(stream) - depth
    found = np.zeros(last, np.uint64)
    for back in range(1, depth + 1):
        found |= stream[depth - back : depth - back + last].astype(np.uint64) << np.uint64(8 * (depth + 1 - back))
    return found | stream[depth:].astype(np.uint64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0: Stirling's series eight steps up."""
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
        if i == 3:
            first, product = np.log(product), np.ones_like(x)
    y = x + 8
    inverse = 1.0 / y
    series = inverse * (1 / 12 - inverse**2 * (1 / 360 - inverse**2 / 1260))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - first - np.log(product)


def block_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Level:
    """The nodes of one depth for one of the eight decisions, over ascending strings."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, bit: int, whole: int):
        byte = (keys & np.uint64(0xFF)).astype(np.int64)
        context = keys >> np.uint64(8 * (whole + 1 - depth))
        node = (context << np.uint64(8)) | ((1 << bit) | (byte >> (8 - bit))).astype(np.uint64)
        self.nodes, self.at = np.unique(node, return_inverse=True)
        one = (byte >> (7 - bit)) & 1 == 1
        n = len(self.nodes)
        self.ones = np.bincount(self.at, np.where(one, counts, 0), n)
        self.zeros = np.bincount(self.at, np.where(one, 0, counts), n)
        self.own = block_estimate(self.zeros, self.ones)
        hit = np.where(one, self.ones[self.at], self.zeros[self.at])
        self.guess = (hit + 0.5) / (self.zeros[self.at] + self.ones[self.at] + 1.0)

    def weigh(self, deeper: "Level | None") -> None:
        if deeper is None:
            self.mixed, self.weight = self.own, np.ones(len(self.nodes))
            return
        below = np.zeros(len(self.nodes))
        first = np.unique(deeper.at, return_index=True)[1]
        np.add.at(below, self.at[first], deeper.mixed)
        self.mixed = HALF + np.logaddexp(self.own, below)
        self.weight = np.exp(HALF + self.own - self.mixed)


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int):
    """Predictions of each string's bits from depth 2 down, and the depth-2 nodes' evidence."""
    predictions, tops = [], []
    for bit in range(8):
        deeper, levels = None, []
        for d in range(depth, 1, -1):
            level = Level(keys, counts, d, bit, depth)
            level.weigh(deeper)
            levels.append(level)
            deeper = level
        p = np.full(len(keys), 0.5)
        for level in levels:
            w = level.weight[level.at]
            p = w * level.guess + (1 - w) * p
        predictions.append(p)
        tops.append(levels[-1])
    return predictions, tops


def _top_rows(tops: list) -> dict[str, np.ndarray]:
    """(latest byte, decision) rows: counts and evidence of the depth-2 nodes below."""
    parts = []
    for top in tops:
        node = top.nodes & np.uint64(0xFF)
        latest = (top.nodes >> np.uint64(16)) & np.uint64(0xFF)
        name, at = np.unique((latest << np.uint64(8)) | node, return_inverse=True)
        parts.append((name, *(np.bincount(at, v, len(name)) for v in (top.zeros, top.ones, top.mixed))))
    columns = [np.concatenate(c) for c in zip(*parts)]
    return dict(zip(("name", "zeros", "ones", "mixed"), (columns[0].astype(np.int64), *columns[1:])))


@dataclass
class Crown:
    """The two top levels: per (latest byte, decision) and per decision, weight and counts."""

    weight1: np.ndarray
    counts1: np.ndarray
    weight0: np.ndarray
    counts0: np.ndarray

    @staticmethod
    def of(rows: list) -> "Crown":
        counts1, below1 = np.zeros((2, 1 << 16)), np.zeros(1 << 16)
        for r in rows:
            counts1[0][r["name"]], counts1[1][r["name"]], below1[r["name"]] = r["zeros"], r["ones"], r["mixed"]
        own1 = block_estimate(counts1[0], counts1[1])
        mixed1 = HALF + np.logaddexp(own1, below1)
        counts0 = counts1.reshape(2, 256, 256).sum(axis=1)
        own0, below0 = block_estimate(counts0[0], counts0[1]), mixed1.reshape(256, 256).sum(axis=0)
        mixed0 = HALF + np.logaddexp(own0, below0)
        return Crown(np.exp(HALF + own1 - mixed1), counts1, np.exp(HALF + own0 - mixed0), counts0)

    def finished(self, keys: np.ndarray, predictions: list[np.ndarray], depth: int) -> np.ndarray:
        """log10 of each string's byte given its context."""
        byte = (keys & np.uint64(0xFF)).astype(np.int64)
        latest = (keys >> np.uint64(8 * depth)).astype(np.int64) & 0xFF
        total = np.zeros(len(keys))
        for bit, p in enumerate(predictions):
            node = (1 << bit) | (byte >> (8 - bit))
            one = (byte >> (7 - bit)) & 1
            for at, weight, counts in (
                ((latest << 8) | node, self.weight1, self.counts1),
                (node, self.weight0, self.counts0),
            ):
                guess = (counts[one, at] + 0.5) / (counts[0, at] + counts[1, at] + 1.0)
                p = weight[at] * guess + (1 - weight[at]) * p
            total += np.log10(p)
        return total


class Words:
    """Hashes of the words of texts; those seen lately are remembered."""

    END = xxhash.xxh64_intdigest(b"", 1)

    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def of(self, data: bytes) -> np.ndarray:
        words = data.split()
        if len(self.seen) > CACHE:
            self.seen.clear()
        seen = self.seen
        for w in set(words):
            if w not in seen:
                seen[w] = xxhash.xxh64_intdigest(w)
        found = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        return np.append(found, np.uint64(self.END))


def _stream(slices: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of several texts and where each text's begin."""
    pad = bytes([START]) * depth
    joined = np.frombuffer(b"".join(pad + s + bytes([STOP]) for s in slices), np.uint8)
    found = strings(joined, depth)
    lengths = np.array([len(s) + 1 for s in slices])
    begins = np.concatenate([[0], np.cumsum(lengths + depth)[:-1]])
    # Strings that end in another text's padding are not strings of a text.
    keep = np.ones(len(found), bool)
    for back in range(depth):
        after = begins[1:] - depth + back
        keep[after] = False
    return found[keep], np.concatenate([[0], np.cumsum(lengths)[:-1]])


class Counter:
    """Running counts of strings or words, folded together now and then."""

    def __init__(self):
        self.keys, self.counts, self.loose = [], [], 0

    def add(self, values: np.ndarray, train: np.ndarray | bool) -> None:
        for part, weight in ((values[train], 1), (values[~train], 0)) if isinstance(train, np.ndarray) else ((values, int(train)),):
            if len(part):
                key, count = np.unique(part, return_counts=True)
                self.keys.append(key)
                self.counts.append(count * weight)
                self.loose += len(key)
        if self.loose > 3 * SLICE:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        key, count = summed(self.keys, self.counts)
        self.keys, self.counts, self.loose = [key], [count], 0
        return key, count


STRINGS, WORDS, DOCUMENT = 0, 1, 2


def _places(keys: np.ndarray, kind: int, depth: int, count: int) -> np.ndarray:
    part = (keys >> np.uint64(8 * (depth - 1))) if kind == STRINGS else (keys >> np.uint64(20))
    mixed = (part * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return (mixed % np.uint64(count)).astype(np.int32)


ASKED = "place int, block int, kind int, keys binary, counts binary"


def _slices(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    held, load = [], 0
    for row in rows:
        held.append(row)
        load += len(row[-1])
        if load > SLICE:
            yield held
            held, load = [], 0
    if held:
        yield held


def _asked(docs: DataFrame, model: Model, places: int) -> DataFrame:
    """What each block holds: its distinct strings and words with their training counts, by place."""
    depth = model.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for block, rows in _streamed(batches):
            found = Counter(), Counter()
            for part in _slices((train, text.translate(LOWER)) for _, train, text in rows):
                values, begins = _stream([t for _, t in part], depth)
                train = np.array([t for t, _ in part], bool)
                found[0].add(values, np.repeat(train, np.diff(np.append(begins, len(values)))))
                told = [words.of(t) for _, t in part]
                found[1].add(np.concatenate(told), np.repeat(train, [len(t) for t in told]))
            for kind in (STRINGS, WORDS):
                key, count = found[kind].fold()
                out = [
                    (p, block, kind, squeezed(key[at]), plain(count[at].astype(np.uint32)))
                    for p, at in by_place(_places(key, kind, depth, places), places)
                ]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                        ["place", "block", "kind", "keys", "counts"],
                    )

    return docs.select("block", "id", "train", "body").mapInArrow(run, ASKED)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(block, its rows as they come) of rows ordered by block; a block is never held whole."""
    import itertools

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))

    for block, part in itertools.groupby(rows(), key=lambda r: r[0]):
        yield block, (r[1:] for r in part)


def _merged(rows: list[tuple], kind: int):
    """Distinct keys of a place with their counts over all blocks, and each block's own keys."""
    asked = [(r[1], expanded(r[3]), r[4]) for r in rows if r[2] == kind]
    key, count = summed([k for _, k, _ in asked], [unplain(c, np.uint32).astype(np.int64) for _, _, c in asked])
    return key, count, [(b, k) for b, k, _ in asked]


@dataclass
class Totals:
    tokens: int
    distinct: int


def _gathered(asked: DataFrame, model: Model) -> tuple[Crown, Totals]:
    """The two top levels and the word totals: bounded sums over all places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches):
            key, count, _ = _merged(rows, STRINGS)
            if len(key):
                found = _top_rows(subtree(key, count, model.depth)[1])
                yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in ("name", "zeros", "ones", "mixed")], ["name", "zeros", "ones", "mixed"])
            key, count, _ = _merged(rows, WORDS)
            if len(key):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1], pa.int64()), *[pa.array([float(v)]) for v in (count.sum(), (count > 0).sum(), 0)]],
                    ["name", "zeros", "ones", "mixed"],
                )

    found = asked.mapInArrow(run, "name long, zeros double, ones double, mixed double")
    rows = found.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "mixed")]).collect()
    words = next((r for r in rows if r["name"] < 0), None)
    totals = Totals(int(words["zeros"]), int(words["ones"])) if words else Totals(0, 0)
    return Crown.of([r for r in rows if r["name"] >= 0]), totals


def _replies(asked: DataFrame, model: Model, crown: Crown) -> DataFrame:
    """(block, kind, keys, values): the numbers a block asked for."""
    shared = asked.sparkSession.sparkContext.broadcast(crown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches):
            out = []
            key, count, blocks = _merged(rows, STRINGS)
            if len(key):
                value = shared.value.finished(key, subtree(key, count, model.depth)[0], model.depth).astype(np.float32)
                out += [(b, STRINGS, squeezed(k), value[np.searchsorted(key, k)].tobytes()) for b, k in blocks]
            key, count, blocks = _merged(rows, WORDS)
            out += [(b, WORDS, squeezed(k), plain(count[np.searchsorted(key, k)])) for b, k in blocks]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                    ["block", "kind", "keys", "body"],
                )

    return asked.mapInArrow(run, "block int, kind int, keys binary, body binary")


class Lookup:
    """Values by key: a direct table of slots, and a search where two keys share one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(int(len(keys) * 4).bit_length(), 4)
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        at[missed] = np.searchsorted(self.keys, keys[missed])
        return self.values[at]


def scored(
    docs: DataFrame, train: Column, model: Model = Model(), *, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) for every row of *docs*."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    blocks = max(1, -(-docs.count() // model.docs_per_block))
    places = max(32, 4 * blocks)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(f"`{key}`"), body), F.lit(blocks)).cast("int").alias("block"),
        F.col(f"`{key}`").alias("id"),
        train.alias("train"),
        body.cast("binary").alias("body"),
    )
    asked = _asked(rows.repartition("block").sortWithinPartitions("block"), model, places)
    asked = materialise(asked, "tree-strings")
    placed = asked.repartition("place").sortWithinPartitions("place")
    crown, totals = _gathered(placed, model)
    replies = _replies(placed, model, crown)
    empty = F.lit(None)
    both = replies.select(
        "block", "kind", empty.cast(kind).alias("id"), F.lit(False).alias("train"), "keys", "body"
    ).unionByName(
        rows.select("block", F.lit(DOCUMENT).alias("kind"), "id", "train", empty.cast("binary").alias("keys"), "body")
    )
    depth, smoothing = model.depth, model.smoothing
    norm = totals.tokens + smoothing * (totals.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for _, part in _streamed(batches):
            numbers: dict[int, list] = {STRINGS: [], WORDS: []}
            lookups = None
            for held in _slices(_documents(part, numbers)):
                if lookups is None:
                    # Replies come before documents in a block.
                    lookups = [Lookup(*(np.concatenate(c) for c in zip(*numbers[k]))) for k in (STRINGS, WORDS)]
                    numbers.clear()
                told = [t.translate(LOWER) for *_, t in held]
                values, begins = _stream(told, depth)
                score = np.add.reduceat(lookups[0](values).astype(np.float64), begins)
                tokens = [words.of(t) for t in told]
                sizes = np.array([len(t) for t in tokens])
                counts = lookups[1](np.concatenate(tokens))
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                base = np.add.reduceat(np.log10((counts + smoothing) / norm), starts)
                known = np.add.reduceat((counts > 0).astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([h[0] for h in held], batch_kind),
                        pa.array([h[1] for h in held], pa.bool_()),
                        pa.array(sizes),
                        pa.array(known),
                        pa.array(np.full(len(held), totals.tokens, np.int64)),
                        pa.array(base),
                        pa.array(score),
                    ],
                    ["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    from pyspark.sql.pandas.types import to_arrow_type

    batch_kind = to_arrow_type(docs.schema[key].dataType)
    schema = f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)


def _documents(rows: Iterator[tuple], numbers: dict) -> Iterator[tuple]:
    """The documents among a block's rows; replies, which come first, are put into *numbers*."""
    for kind, id_, train, keys, body in rows:
        if kind == DOCUMENT:
            yield id_, train, body
        elif kind == STRINGS:
            numbers[kind].append((expanded(keys), np.frombuffer(body, np.float32)))
        else:
            numbers[kind].append((expanded(keys), unplain(body, np.int64)))
