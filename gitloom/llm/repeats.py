"""Removing repeated passages with enhanced suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
id. Strings are compared exactly, inside documents only, and judged on the input.

1. A suffix array of every position of a corpus is larger than the corpus by far, so it is sparse:
   suffixes start at anchors. A string's anchors are the positions of its smallest hashed k-gram,
   which depend on the string alone, so equal strings have equal anchors in equal places.
2. Anchors whose k-gram no other document has cannot lie in a repeat; which ones are shared is
   found by an exchange of hashes (shared_sets).
3. A shared anchor's suffix (the bytes to its right) and what stands to its left go to the place of
   its k-gram, equal surroundings of one batch once. There the suffixes are sorted, with the length
   of the prefix common to neighbours. One scan with a stack finds every interval of a common
   prefix, the nodes of the interval tree, each with all its occurrences. An interval whose members
   go on alike to the left as far as a string needs is one group; where left extensions differ, its
   members are parted by them. Every group's occurrences but those of its smallest document go.
4. Each document gets the spans found in it, from wherever they were found, and is cut once.

Equal surroundings in a batch go out once, so a third of all rows that are copies are a few rows to
a place. Documents without a shared anchor are never shuffled.

NULL and empty texts are empty. NULL ids count as larger than all others and as equal to each
other. Rows with the same id are one document's: none removes from the other. Texts shorter than a
string stay. Long texts are read in overlapping pieces. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gitloom.llm.common import ROW
from gitloom.llm.packed import by_place, give_back, groups, plain, tagged, unplain, untagged
from gitloom.llm.shared_sets import FINISH, MIX, SHIFT, combined, place_of, place_of_owner, shared_sets
from gitloom.session import materialise

PIECE = 1 << 21
# Positions that are hashed at a time.
BLOCK = 1 << 17
# Surroundings that are judged at a time, and the rest of the last one's group.
JUDGED = 1 << 14
LAST = (1 << 63) - 1
CELL_BITS = 20
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Rule:
    length: int = 50
    gram: int = 16
    docs_per_place: int = 4096

    @property
    def left(self) -> int:
        return self.length - self.gram


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """*best* (minimum or maximum) of every *width* values in a row."""
    done, result = 1, values
    while done < width:
        step = min(done, width - done)
        result = best(result[:-step], result[step:])
        done += step
    return result


class Stream:
    """Several texts as one array of bytes plus one, kept apart by zeros."""

    def __init__(self, bodies: list[bytes], rule: Rule):
        gap = rule.length
        self.lengths = np.array([len(b) for b in bodies], np.int64)
        self.begins = gap + np.concatenate([[0], np.cumsum(self.lengths + gap)[:-1]])
        joined = bytes(gap) + b"".join(b + bytes(gap) for b in bodies)
        self.bytes = np.frombuffer(joined, np.uint8) + np.uint8(1)
        self.bytes[:gap] = 0
        for begin, end in zip((self.begins + self.lengths).tolist(), (self.begins + self.lengths + gap).tolist()):
            self.bytes[begin:end] = 0

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, positions, side="right") - 1

    def anchors(self, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the k-grams that are smallest in some string."""
        span = rule.length - rule.gram + 1
        found = []
        for begin in range(0, max(len(self.bytes) - rule.length + 1, 0) + span - 1, BLOCK):
            # All strings that hold a k-gram of this block.
            low = max(begin - span + 1, 0)
            at, hashes = _smallest(self.bytes[low : begin + BLOCK + rule.length - 1], rule)
            a, b = np.searchsorted(at, (begin - low, begin - low + BLOCK))
            found.append((at[a:b] + low, hashes[a:b]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at, hashes = (np.concatenate(c) for c in zip(*found))
        # The smallest hashes lie close to 0. Mixed again, one to one, they fill all places alike.
        hashes = (hashes ^ (hashes >> SHIFT)) * FINISH
        return at, hashes ^ (hashes >> SHIFT)


def _smallest(data: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are smallest in some string of *data*."""
    span = rule.length - rule.gram + 1
    if len(data) < rule.length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    words = data.astype(np.uint64)
    for shift, step in ((8, 1), (16, 2), (32, 4)):
        words = (words[:-step] << np.uint64(shift)) | words[step:]
    hashes = words[: len(data) - rule.gram + 1] * MIX
    for at in range(8, rule.gram, 8):
        back = min(at, rule.gram - 8)
        hashes ^= hashes >> SHIFT
        hashes = (hashes ^ words[back : back + len(hashes)]) * MIX
    hashes ^= hashes >> SHIFT
    least = sliding(hashes, span, np.minimum)
    zeros = np.concatenate([[0], np.cumsum(data == 0)])
    whole = zeros[rule.length :] == zeros[: -rule.length]
    least = np.where(whole, least, np.uint64(0))
    # A k-gram lies in *span* strings; it is an anchor if it is smallest in one of them.
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    most = sliding(padded, span, np.maximum)
    at = np.flatnonzero((most == hashes) & (most > 0))
    return at, hashes[at]


def _pieces(rows, rule: Rule):
    """(name, rank, offset, bytes) pieces of the rows' texts, some millions of bytes at a time."""
    held, load = [], 0
    for name, rank, body in rows:
        for offset in range(0, max(len(body) - rule.length + 1, 0), PIECE):
            piece = body[offset : offset + PIECE + rule.length - 1]
            if held and load + len(piece) > PIECE:
                yield held
                held, load = [], 0
            held.append((name, rank, offset, piece))
            load += len(piece) + rule.length
    if held:
        yield held


def _rows(batch: pa.RecordBatch, *columns: int):
    return zip(*(batch.column(i).to_pylist() for i in columns))


def _anchor_sets(rule: Rule):
    """From batches of (class, rank, body) to batches of (class, n, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list[np.ndarray]] = {}
            for part in _pieces(_rows(batch, 0, 1, 2), rule):
                stream = Stream([p[3] for p in part], rule)
                at, hashes = stream.anchors(rule)
                edges = np.searchsorted(at, np.append(stream.begins, len(stream.bytes)))
                for (name, *_), a, b in zip(part, edges.tolist(), edges[1:].tolist()):
                    found.setdefault(name, []).append(hashes[a:b])
            sets = {name: np.unique(np.concatenate(parts)) for name, parts in found.items()}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(sets), pa.int64()),
                    pa.array([len(s) for s in sets.values()], pa.int64()),
                    pa.array([s.tobytes() for s in sets.values()], pa.binary()),
                ],
                ["class", "n", "hashes"],
            )

    return run


SENT = "place int, kind int, names binary, a binary, b binary, c binary"
CONTEXTS, SPANS = 0, 1


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["place", "kind", "names", "a", "b", "c"]
    )


def _span_rows(names: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: int) -> list[tuple]:
    return [
        (p, SPANS, tagged(names[at]), plain(starts[at]), plain(ends[at]), b"")
        for p, at in by_place(place_of_owner(names, count), count)
    ]


def _context_rows(
    which: np.ndarray, names: np.ndarray, wide: np.ndarray, ranks: np.ndarray, at: np.ndarray, hashes: np.ndarray, count: int
) -> list[tuple]:
    # Each place's rows are taken by themselves, so the work does not grow with the number of places.
    dealt = ((p, which[w]) for p, w in by_place(place_of(hashes[which], count), count))
    return [(p, CONTEXTS, tagged(names[w]), plain(wide[w]), tagged(ranks[w]), plain(at[w])) for p, w in dealt]


def _contexts(rule: Rule, count: int):
    """From (class, rank, body, hashes) to the surroundings of shared anchors, by place."""
    width = rule.left + rule.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [np.frombuffer(h, np.uint64) for h in batch.column(3).to_pylist()]
            shared = np.unique(np.concatenate(shared)) if shared else np.empty(0, np.uint64)
            for part in _pieces(_rows(batch, 0, 1, 2), rule):
                stream = Stream([p[3] for p in part], rule)
                at, hashes = stream.anchors(rule)
                hit = np.minimum(np.searchsorted(shared, hashes), max(len(shared) - 1, 0))
                keep = shared[hit] == hashes if len(shared) else np.zeros(len(at), bool)
                at, hashes = at[keep], hashes[keep]
                if not len(at):
                    continue
                owner = stream.owner(at)
                names = np.array([p[0] for p in part], np.int64)[owner]
                ranks = np.array([p[1] for p in part], np.int64)[owner]
                offsets = np.array([p[2] for p in part], np.int64)[owner]
                inside = at - stream.begins[owner]
                # The gaps between texts are as long as a string, so surroundings never leave the stream.
                wide = np.lib.stride_tricks.sliding_window_view(stream.bytes, width)[at - rule.left]
                padding = -wide.shape[1] % 8
                words = np.pad(wide, ((0, 0), (0, padding))).view(np.uint64)
                same = combined(list(words.T))
                # Beyond a zero another text begins.
                order = np.lexsort((ranks, same))
                first = np.concatenate([[True], same[order][1:] != same[order][:-1]])
                lowest = ranks[order][first][np.cumsum(first) - 1]
                later = order[ranks[order] > lowest]
                once = order[first]
                sent = names, wide, ranks, inside + offsets, hashes
                rows = _context_rows(once, *sent, count)
                # Others in this batch have the same surroundings and a smaller id: all of it goes.
                low = np.maximum(inside - rule.left, 0)
                high = np.minimum(inside + rule.length, stream.lengths[owner])
                rows += _span_rows(names[later], (low + offsets)[later], (high + offsets)[later], count)
                # Equal surroundings with the same rank beside the one sent: they get what that one gets.
                twins = order[(ranks[order] == lowest) & ~first]
                rows += _context_rows(twins, *sent, count)
                yield _sent(rows)
                # Nothing of a piece is held while the next one is read.
                del stream, wide, words, same, order, rows, sent, at, hashes
                give_back()

    return run


def suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows, and how long a prefix each shares with the one before it."""
    padding = -rows.shape[1] % 8
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, padding)))).view(">u8")
    order = np.lexsort(tuple(words[:, i].astype(np.uint64) for i in range(words.shape[1] - 1, -1, -1)))
    placed = rows[order]
    return order, _common(placed[1:], placed[:-1])


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the rows of *a* and *b*, counting no zeros; 0 for the first row."""
    differ = (a != b) | (a == 0)
    full = ~differ.any(axis=1)
    found = np.where(full, a.shape[1], differ.argmax(axis=1)) if len(a) else np.empty(0, np.int64)
    return np.concatenate([[0], found]).astype(np.int64)


def intervals(lcp: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The interval tree's nodes (first, end, depth, parent's depth, common left) of depth *least* up.

    One scan with a stack. *lcp* and *left* are what neighbours share to the right and to the left.
    """
    stack: list[list[int]] = []  # [first, depth, common left]
    n = len(lcp)
    for i in range(1, n + 1):
        depth = lcp[i] if i < n else 0
        if depth < least:
            depth = 0
        first, carried = i - 1, left[i] if i < n else 0
        while stack and stack[-1][1] > depth:
            start, deep, common = stack.pop()
            parent = max(depth, stack[-1][1] if stack else 0)
            yield start, i, deep, parent, common
            first = start
            if stack and stack[-1][1] >= depth and stack[-1][1] > 0:
                stack[-1][2] = min(stack[-1][2], common)
            carried = min(carried, common)
        if depth:
            if stack and stack[-1][1] == depth:
                stack[-1][2] = min(stack[-1][2], left[i])
            else:
                stack.append([first, depth, carried])


def repeated(contexts: np.ndarray, ranks: np.ndarray, rule: Rule) -> np.ndarray:
    """Per surrounding, a bit for each string around its anchor that a smaller rank has too.

    Bit s stands for the string that begins s bytes before the anchor.
    """
    n, reach, length = len(contexts), rule.left, rule.length
    right, behind = contexts[:, reach:], contexts[:, :reach][:, ::-1]
    order, lcp = suffix_order(right)
    behind, rank = behind[order], ranks[order]
    common = _common(behind[1:], behind[:-1])
    masks = np.zeros(n, np.uint64)
    diverse = np.zeros((reach + 1, n + 1), np.int32)
    any_diverse = False
    for first, end, depth, parent, alike in intervals(lcp.tolist(), common.tolist(), rule.gram):
        low, high = length - depth, min(length - parent - 1, reach)
        part = rank[first:end]
        least = part.min()
        if low <= min(high, alike):
            bits = np.uint64(((1 << (min(high, alike) + 1)) - 1) ^ ((1 << low) - 1))
            masks[first:end] |= np.where(part > least, bits, np.uint64(0))
        if alike < high and least < part.max():
            # Left extensions differ here: these levels are parted by what stands to the left.
            for s in range(max(low, alike + 1), high + 1):
                diverse[s, first] += 1
                diverse[s, end] -= 1
            any_diverse = True
    if any_diverse:
        left_order, left_lcp = suffix_order(np.ascontiguousarray(behind))
        for s in range(reach + 1):
            rows = np.flatnonzero(np.cumsum(diverse[s])[:n] > 0)
            if not len(rows):
                continue
            right_group = np.cumsum(lcp < length - s)
            left_group = np.empty(n, np.int64)
            left_group[left_order] = np.cumsum(left_lcp < s) if s else 0
            key = right_group[rows] * np.int64(n + 1) + left_group[rows]
            by = np.lexsort((rank[rows], key))
            fresh = np.concatenate([[True], key[by][1:] != key[by][:-1]])
            least = rank[rows][by][fresh][np.cumsum(fresh) - 1]
            late = rows[by][rank[rows][by] > least]
            masks[late] |= np.uint64(1 << s)
    result = np.zeros(n, np.uint64)
    result[order] = masks
    return result


def by_gram(contexts: np.ndarray, rule: Rule, most: int = JUDGED) -> Iterator[np.ndarray]:
    """Rows with the same k-gram at their anchor, whole groups together, some thousands of rows at a time.

    Strings around an anchor are equal only where the k-gram is, so groups are judged apart.
    """
    if len(contexts) <= most:
        yield np.arange(len(contexts))
        return
    grams = np.ascontiguousarray(contexts[:, rule.left : rule.left + rule.gram])
    order, shared = suffix_order(grams)
    starts = np.flatnonzero(shared < rule.gram)
    chunk = starts // most
    cuts = starts[np.flatnonzero(np.diff(chunk)) + 1].tolist()
    for a, b in zip([0, *cuts], [*cuts, len(order)]):
        yield order[a:b]


def _judged(rule: Rule, count: int):
    """At the place of an anchor: which strings go, as spans, dealt by document."""
    width = rule.left + rule.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches):
            passed = [r for r in rows if r[1] == SPANS]
            if passed:
                yield _sent(passed)
            asked = [r for r in rows if r[1] == CONTEXTS]
            if not asked:
                continue
            names = np.concatenate([untagged(r[2]) for r in asked])
            contexts = np.concatenate([unplain(r[3], np.uint8).reshape(-1, width) for r in asked])
            ranks = np.concatenate([untagged(r[4]) for r in asked])
            at = np.concatenate([unplain(r[5], np.int64) for r in asked])
            masks = np.zeros(len(contexts), np.uint64)
            for part in by_gram(contexts, rule):
                masks[part] = repeated(contexts[part], ranks[part], rule)
            del contexts
            found = []
            for s in range(rule.left + 1):
                has = (masks >> np.uint64(s)) & np.uint64(1) == 1
                if s < rule.left:  # only where the next string does not go too
                    has &= (masks >> np.uint64(s + 1)) & np.uint64(1) == 0
                run_rows = np.flatnonzero(has)
                if len(run_rows):
                    # Down to the lowest bit of this run of ones.
                    end = _run_length(masks[run_rows], s)
                    found.append((run_rows, at[run_rows] - s, at[run_rows] - s + end - 1 + rule.length))
            if found:
                which, starts, ends = (np.concatenate(c) for c in zip(*found))
                yield _sent(_span_rows(names[which], starts, ends, count))
            del rows, asked, passed, found, names, ranks, at, masks
            give_back()

    return run


def _run_length(masks: np.ndarray, s: int) -> np.ndarray:
    """How many ones stand in a row from bit *s* downwards."""
    length = np.zeros(len(masks), np.int64)
    going = np.ones(len(masks), bool)
    for bit in range(s, -1, -1):
        going &= (masks >> np.uint64(bit)) & np.uint64(1) == 1
        if not going.any():
            break
        length += going
    return length


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    reach = np.maximum.accumulate(ends)
    fresh = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(starts) - 1)
    return starts[fresh], reach[last]


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in groups(batches):
        names = np.concatenate([untagged(r[2]) for r in rows])
        starts = np.concatenate([unplain(r[3], np.int64) for r in rows])
        ends = np.concatenate([unplain(r[4], np.int64) for r in rows])
        order = np.argsort(names, kind="stable")
        names, starts, ends = names[order], starts[order], ends[order]
        edges = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])).tolist() + [len(names)]
        found = [(names[a], *merged(starts[a:b], ends[a:b])) for a, b in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([f[1].tobytes() for f in found], pa.binary()),
                pa.array([f[2].tobytes() for f in found], pa.binary()),
            ],
            ["class", "starts", "ends"],
        )


def _cell(name: str) -> Column:
    return F.pmod(F.xxhash64(name, F.lit(9)), F.lit(1 << CELL_BITS)).cast("int")


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def without_repeats(
    docs: DataFrame, rule: Rule = Rule(), *, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(_row, n_bytes, kept, spans): each document's remaining bytes and the runs that were removed."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW),
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("rank"),
        body.alias("body"),
    ).withColumn("class", F.xxhash64("rank", "body"))
    slim = named.select("class", "rank", "body")
    count = max(16, docs.count() // rule.docs_per_place)
    shared = materialise(shared_sets(slim, _anchor_sets(rule), count, 0), "repeat-anchors").select("class", "hashes")
    cells = shared.select(_cell("class").alias("cell")).distinct()
    held = slim.withColumn("cell", _cell("class")).join(F.broadcast(cells), "cell", "left_semi")
    sent = held.join(shared, "class").select("class", "rank", "body", "hashes").mapInArrow(_contexts(rule, count), SENT)
    judged = sent.repartition("place").sortWithinPartitions("place").mapInArrow(_judged(rule, count), SENT)
    spans = judged.repartition("place").sortWithinPartitions("place").mapInArrow(
        _per_document, "class long, starts binary, ends binary"
    )
    spans = materialise(spans, "repeat-spans").withColumnRenamed("class", "c")
    touched = spans.select(_cell("c").alias("cell")).distinct().withColumn("hit", F.lit(True))
    marked = named.withColumn("cell", _cell("class")).join(F.broadcast(touched), "cell", "left")
    whole = marked.filter(F.col("hit").isNull()).select(
        ROW, F.octet_length("body").cast("long").alias("n_bytes"), F.col("body").alias("kept"), F.array().cast(SPAN).alias("spans")
    )
    cut = marked.filter("hit").join(spans, F.col("class") == F.col("c"), "left").select(ROW, "body", "starts", "ends")
    return whole.unionByName(_cut(cut))


def _cut(rows: DataFrame) -> DataFrame:
    schema = T.StructType(
        [rows.schema[ROW], T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("spans", SPAN)]
    )
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, spans = [], [], []
            for data, starts, ends in _rows(batch, 1, 2, 3):
                runs = []
                if starts is not None:
                    runs = list(zip(np.frombuffer(starts, np.int64).tolist(), np.frombuffer(ends, np.int64).tolist()))
                edges = [0, *(e for r in runs for e in r), len(data)]
                sizes.append(len(data))
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "length": b - a} for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)],
                [ROW, "n_bytes", "kept", "spans"],
            )

    return rows.mapInArrow(run, schema)
