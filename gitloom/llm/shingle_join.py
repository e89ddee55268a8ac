"""Similarity join on word shingles by set relations, and the groups it links.

A document's set holds its distinct five-word shingles as 64-bit hashes. Two documents link when
their sets' Jaccard similarity reaches the threshold; the answer is exact up to hash collisions.

1. Documents with equal sets are one class; what follows works on classes.
2. A shingle that only one class has can never be common, so a class whose other shingles are less
   than the threshold's share of its set has no link. Which shingles are shared is found in buckets
   of hashes; a batch sends each of its hashes once. Two rounds leave the classes that can link.
   The rows' names and sizes travel with the first round, so each text is read once.
3. Of these, each takes the prefix of its set, rarest first, that any partner has to share, and
   classes that share a prefix shingle and are of fitting size fall into one block (connected
   components over one edge per entry at most, not over pairs: prefix_blocks). Links never leave a block.
4. In a block every set asks an index whose lists are ordered by position, so entries whose rest is
   too short for the threshold are skipped as a whole. A set that resembles one already answered
   starts from that set's overlaps and only adds and subtracts the lists in which they differ. A
   block too large for a task is cut into parts, and every two parts are one task, which gives back
   counts and a spanning forest: rows grow with the sets, not with the pairs.

NULL texts and texts without words have the empty set and link with nothing. Texts of fewer than
five words are one shingle as a whole. Ties have no part. Repeated rows are copies like others.
NULL ids are never chosen as a component's id while another exists. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitloom.llm import prefix_blocks
from gitloom.llm.common import LOWER, ROW, texts
from gitloom.llm.components import components
from gitloom.llm.shared_sets import combined, shared_sets
from gitloom.session import materialise

CACHE = 150_000
# Words whose shingles are made at a time.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Join:
    words: int = 5
    percent: int = 75
    # What a part of a block holds at most: sets, and shared shingles of them.
    part_sets: int = 512
    part_shingles: int = 1 << 19
    docs_per_bucket: int = 4096


class Seen(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


class Shingler:
    """Hashed shingle sets of texts; words seen lately keep their hash."""

    def __init__(self, words: int):
        self.words, self.seen = words, Seen()

    def of(self, bodies: list[bytes]) -> list[np.ndarray]:
        found, held, load = [], [], 0
        for data in bodies:
            words = data.translate(LOWER).split()
            if len(self.seen) > CACHE:
                self.seen.clear()
            held.append(np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words)))
            load += len(words)
            if load > CHUNK:
                found += self._sets(held)
                held, load = [], 0
        return found + self._sets(held)

    def _sets(self, held: list[np.ndarray]) -> list[np.ndarray]:
        """The sets of some texts from their words' hashes; shingles that reach into the next text are left out."""
        joined = np.concatenate([*held, np.zeros(self.words - 1, np.uint64)])
        last = len(joined) - self.words + 1
        every = combined([joined[i : i + last] for i in range(self.words)])
        edges, begin = [], 0
        for hashes in held:
            edges.append((begin, begin + max(len(hashes) - self.words + 1, 0)))
            every[slice(*edges[-1])].sort()
            begin += len(hashes)
        fresh = np.append(True, every[1:] != every[:-1])[:last]
        fresh[[a for a, b in edges if a < b]] = True
        return [
            every[a:b][fresh[a:b]] if a < b else combined([h[i : i + 1] for i in range(len(h))]) if len(h) else h
            for h, (a, b) in zip(held, edges)
        ]


def class_of(values: np.ndarray) -> int:
    """A signed 64-bit name of a set: equal sets share it."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())).astype(np.int64))


def _sets(join: Join):
    """From batches of (id, text) to batches of (class, n, hashes, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(join.words)
        for batch in batches:
            found = shingler.of(texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([class_of(s) for s in found], pa.int64()),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([s.tobytes() for s in found], pa.binary()),
                    *(batch.column(i) for i in range(batch.num_columns) if i != 1),
                ],
                ["class", "n", "hashes", "id", "th"],
            )

    return run


def least_overlap(a, b, percent: int):
    """The smallest overlap with which sets of these sizes reach the threshold."""
    return -(-(percent * (a + b)) // (100 + percent))


class SetIndex:
    """Answers sets against each other inside one task."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, join: Join):
        self.join, self.sizes = join, sizes
        self.n = len(sets)
        lengths = np.array([len(s) for s in sets])
        _, local, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # Tokens numbered by how rare they are here: the order in which a set is read.
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        owner = np.repeat(np.arange(self.n), lengths)
        token = rank[local.ravel()]
        order = np.lexsort((token, owner))
        edges = np.concatenate([[0], np.cumsum(lengths)])
        token = token[order]
        self.tokens = [token[a:b] for a, b in zip(edges, edges[1:])]
        rest = np.repeat(lengths, lengths) - 1 - (np.arange(len(token)) - np.repeat(edges[:-1], lengths))
        # A token's list holds (set, how many tokens of the set come after), longest rest first.
        by = np.lexsort((-rest, token))
        self.owners, self.rests = owner[by].astype(np.int32), rest[by].astype(np.int32)
        self.starts = np.searchsorted(token[by], np.arange(len(counts) + 1))
        self.mark = np.zeros(len(counts), bool)

    def lists(self, tokens: np.ndarray) -> np.ndarray:
        parts = [self.owners[self.starts[t] : self.starts[t + 1]] for t in tokens.tolist()]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def candidates(self, x: int) -> np.ndarray:
        """Sets that share a prefix token with *x* in a place from which enough can follow."""
        own, size = self.tokens[x], int(self.sizes[x])
        least = -(-self.join.percent * size // 100)
        found = []
        for p, t in enumerate(own[: max(len(own) - least + 1, 0)].tolist()):
            a, b = self.starts[t], self.starts[t + 1]
            # Beyond this place of the list no rest is long enough: skipped as a whole.
            b = a + np.searchsorted(-self.rests[a:b], -(least - 1), side="right")
            owners, rests = self.owners[a:b], self.rests[a:b]
            reach = 1 + np.minimum(rests, len(own) - 1 - p)
            found.append(owners[reach >= least_overlap(size, self.sizes[owners], self.join.percent)])
        found = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return found[found != x]

    def answers(self) -> Iterator[tuple[int, np.ndarray]]:
        """(set, the sets it links with), for every set."""
        close = np.zeros(self.n, np.int64)
        origin = np.full(self.n, -1)
        kept: dict[int, np.ndarray] = {}
        for x in range(self.n):
            own, whole = self.tokens[x], True
            y = int(origin[x])
            if y >= 0 and len(own) + len(self.tokens[y]) - 2 * close[x] < len(own) // 2:
                # The answers of a set much like this one, but for the tokens in which they differ.
                more = np.setdiff1d(own, self.tokens[y], assume_unique=True)
                less = np.setdiff1d(self.tokens[y], own, assume_unique=True)
                overlap = kept[y] + np.bincount(self.lists(more), minlength=self.n)
                overlap -= np.bincount(self.lists(less), minlength=self.n)
            else:
                near = self.candidates(x)
                if not len(near):
                    yield x, near
                    continue
                if len(near) > 8:
                    overlap = np.bincount(self.lists(own), minlength=self.n)
                else:
                    whole = False
                    overlap = np.zeros(self.n, np.int64)
                    self.mark[own] = True
                    for c in near.tolist():
                        overlap[c] = np.count_nonzero(self.mark[self.tokens[c]])
                    self.mark[own] = False
            later = overlap > close
            later[: x + 1] = False
            if whole and later.any():
                kept[x] = overlap
                close[later], origin[later] = overlap[later], x
                if len(kept) > 64:
                    live = set(origin[x + 1 :].tolist())
                    kept = {k: v for k, v in kept.items() if k in live}
            linked = 100 * overlap >= self.join.percent * (self.sizes[x] + self.sizes - overlap)
            linked[x] = False
            yield x, np.flatnonzero(linked & (overlap > 0))


def _answered(names: np.ndarray, sizes: np.ndarray, members: np.ndarray, side: np.ndarray, sets: list, join: Join, across: bool):
    """(class, root, links) of a task's sets; *across*: only links between its two sides count."""
    order = np.lexsort((names, sizes))
    names, sizes, members, side = names[order], sizes[order], members[order], side[order]
    index = SetIndex([sets[i] for i in order.tolist()], sizes, join)
    parent = np.arange(len(names))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = np.zeros(len(names), np.int64)
    for x, found in index.answers():
        if across:
            found = found[side[found] != side[x]]
        links[x] = members[found].sum()
        for y in found.tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(len(names))])
    linked = links > 0
    return names[linked], names[roots][linked], links[linked]


def grouped(docs: DataFrame, join: Join = Join(), *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, th, n, component, links, root) for every row; th: the text's hash; counts the other rows it links with; root: a class of the group."""
    value = F.col(f"`{text}`")
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("id"), value.alias("_text"), F.xxhash64(value).alias("th"))
    make = _sets(join)
    count = max(16, docs.count() // join.docs_per_bucket)
    once = materialise(shared_sets(slim, make, count, join.percent, ("id", "th")), "shingle-sets")
    # Without th: a set. With it: a row, which has the hash of its text even if that is NULL.
    named = once.filter("th is not null").select("id", "th", "class", "n")
    sets = once.filter("th is null").select("class", "n", "hashes")
    places = max(16, count // 4)
    reduced = shared_sets(sets, lambda batches: batches, places, join.percent)
    reduced = materialise(reduced.withColumnRenamed("hashes", "shingles"), "shingle-sets")
    members = named.groupBy("class").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("low"))

    edges = prefix_blocks.edges(reduced, places, join.percent)
    blocks = components(edges).select(F.col("node").alias("class"), F.col("root").alias("block"))
    blocks = materialise(blocks, "shingle-blocks")
    loads = reduced.select("class", (F.octet_length("shingles") / 8).alias("load")).join(blocks, "class")
    needed = F.greatest(F.count(F.lit(1)) / join.part_sets, F.sum("load") / join.part_shingles)
    parts = loads.groupBy("block").agg(F.ceil(needed).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("class", F.lit(5)), F.col("parts")).cast("int")
    sized = reduced.join(blocks, "class").join(parts, "block").join(members.select("class", "members"), "class")
    sized = sized.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # Both sides of every two parts meet under the same key, the smaller part first.
    tasks = sized.select(
        "block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "class", "n", "members", "shingles"
    )

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # One of two parts may be empty: the task's name says what counts, not the sides present.
        across = key[1] != key[2]
        if across and rows["part"].nunique() < 2:
            rows = rows[:0]
        held = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        columns = [rows[c].to_numpy() for c in ("class", "n", "members", "part")]
        found = _answered(*columns, held, join, across) if held else ([], [], [])
        return pd.DataFrame(dict(zip(("class", "root", "links"), found)))

    answers = materialise(
        tasks.groupBy("block", "i", "j").applyInPandas(answer, "class long, root long, links long"), "shingle-links"
    )
    roots = components(answers.select(F.col("class").alias("u"), F.col("root").alias("v")))
    known = answers.groupBy("class").agg(F.sum("links").alias("links"))
    per_class = members.join(known, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    rooted = per_class.withColumn("root", F.coalesce("root", "class"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component"))
    final = rooted.join(lows, "root").select("class", "root", "component", "members", F.coalesce("links", F.lit(0)).alias("links"))
    joined = named.join(final, "class")
    empty = F.col("n") == 0
    return joined.select(
        "id",
        "th",
        "n",
        F.when(empty, F.col("id")).otherwise(F.col("component")).alias("component"),
        F.when(empty, F.lit(0)).otherwise(F.col("links") + F.col("members") - 1).cast("long").alias("links"),
        "root",
    )


def kept(docs: DataFrame, join: Join = Join(), *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group, with the columns of *docs*: the smallest id's, repeated rows once.

    A document with the empty set is a group of its own.
    """
    found = grouped(docs, join, text=text, key=key)
    alone = F.when(F.col("n") == 0, F.struct("id", "th"))
    # Ids may be NULL or stand for several texts, so groups are told apart by root.
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "th"))
    chosen = found.groupBy("root", alone.alias("e")).agg(first.alias("f"))
    last = F.lit((1 << 63) - 1)
    chosen = chosen.select(F.coalesce("f.id", last).alias("k"), F.col("f.th").alias("h")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)
    named = docs.select(row, F.coalesce(F.col(f"`{key}`").cast("long"), last).alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    return named.join(chosen, ["k", "h"]).dropDuplicates(["k", "h"]).select(f"{ROW}.*")
