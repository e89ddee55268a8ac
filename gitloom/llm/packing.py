"""Lexical retrieval packing.

Documents are read in shards: consecutive documents of an input partition, up to a number of
tokens. Each shard gets a BM25 inverted index over its token ids. Windows are filled greedily: the
document that opens a window is the seed, all its tokens are asked of the index, and the best
unused neighbours follow it, those that fit the gap first; if none fits, the best one is cut
and its rest opens the next window. Where no unused neighbour shares a token, the next document in
order follows, so a window is never left open.

Only a shard's last window can come short. It is cut into sequences whose lengths are powers of
two, which need no padding. So no shuffle, no padding, and memory bounded by a shard, which is a
few million tokens or one document, whichever is more. A partition read again gives the same
sequences.

NULL and empty texts are one end token, and follow a shard's other documents. A text longer than a shard is a shard of its own. Equal
documents are ordinary documents; ties in score go to the earlier one. Null ids are carried. An
empty table gives an empty table.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = 1
# Tokens that more than one in so many documents of a shard have lie as whole rows of weights.
DENSE = 8


@dataclass(frozen=True)
class Packer:
    window: int = 2048
    shard_tokens: int = 1 << 22
    # How many of a seed's tokens are asked, rarest first; None: all of them.
    query_tokens: int | None = None
    neighbours: int = 8
    k1: float = 1.2
    b: float = 0.75
    # The tokenizer's file, and the same vocabulary as ranks; None: the public tokenizers' files.
    vocabulary: str | None = None
    ranks: str | None = None


class Tokens:
    """Token ids of a text as the tokenizer file gives them.

    The same merges are run by the faster of the two libraries. A text that holds one of the
    tokenizer's special strings goes through the tokenizer itself.
    """

    def __init__(self, vocabulary: str | None, ranks: str | None):
        import public_tokenizers
        import tiktoken

        self.vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}
        )
        with open(self.vocabulary, encoding="utf-8") as held:
            self.special = [t["content"] for t in json.load(held)["added_tokens"]]
        self.whole = None

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.vocabulary)
            found = np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        else:
            found = self.fast.encode_to_numpy(text, disallowed_special=())
        return np.append(found.astype("<u4"), np.array([END], dtype="<u4"))


@lru_cache(maxsize=2)
def tokens(vocabulary: str | None, ranks: str | None) -> Tokens:
    return Tokens(vocabulary, ranks)


class Index:
    """BM25 over one shard. Postings lie token by token, each with its finished weight."""

    def __init__(self, documents: list[np.ndarray], packer: Packer):
        self.n = len(documents)
        lengths = np.fromiter(map(len, documents), np.int64, self.n)
        flat = np.concatenate(documents).astype(np.int64)
        owner = np.repeat(np.arange(self.n), lengths)
        pairs, counts = np.unique((flat << 32) | owner, return_counts=True)
        token, doc = pairs >> 32, pairs & 0xFFFFFFFF
        vocabulary = int(flat.max()) + 1
        df = np.bincount(token, minlength=vocabulary)
        self.idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        self.idf[df < 2] = 0.0  # of no use: only its own document has it
        norm = packer.k1 * (1 - packer.b + packer.b * lengths / lengths.mean())
        weights = self.idf[token] * counts * (packer.k1 + 1) / (counts + norm[doc])
        self.query_tokens = packer.query_tokens
        self._hold(np.arange(self.n), token, doc, weights)

    def _hold(self, live: np.ndarray, token: np.ndarray, doc: np.ndarray, weights: np.ndarray) -> None:
        """Postings of the *live* documents, *doc* being places among them; frequent tokens as rows."""
        self.live, self.token, self.docs, self.weights = live, token, doc, weights
        df = np.bincount(token, minlength=len(self.idf))
        self.starts = np.concatenate([[0], np.cumsum(df)])
        often = np.flatnonzero(df * DENSE > len(live))
        self.row = np.full(len(df), -1)
        self.row[often] = np.arange(len(often))
        held = self.row[token] >= 0
        self.dense = np.zeros((len(often), len(live)))
        self.dense[self.row[token[held]], doc[held]] = weights[held]

    def narrow(self, unused: np.ndarray) -> None:
        """Forget the documents that are used up; weights stay those of the whole shard."""
        left = unused[self.live]
        place = np.cumsum(left) - 1
        stay = left[self.docs]
        self._hold(self.live[left], self.token[stay], place[self.docs[stay]], self.weights[stay])

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Every held document's score for the tokens of *ids*; 0 for those forgotten."""
        asked = np.unique(ids)
        asked = asked[self.idf[asked] > 0]
        if self.query_tokens is not None and len(asked) > self.query_tokens:
            asked = asked[np.argpartition(-self.idf[asked], self.query_tokens)[: self.query_tokens]]
        rows = self.row[asked]
        found = self.dense[rows[rows >= 0]].sum(axis=0)
        rest = asked[rows < 0]
        spans = [slice(a, b) for a, b in zip(self.starts[rest].tolist(), self.starts[rest + 1].tolist()) if a < b]
        if spans:
            docs = np.concatenate([self.docs[s] for s in spans])
            found += np.bincount(docs, np.concatenate([self.weights[s] for s in spans]), len(self.live))
        scores = np.zeros(self.n)
        scores[self.live] = found
        return scores


def order(documents: list[np.ndarray], packer: Packer) -> list[int]:
    """The documents in the order in which they fill windows, each once; those without a word last."""
    worded = [d for d, ids in enumerate(documents) if len(ids) > 1]
    bare = [d for d, ids in enumerate(documents) if len(ids) <= 1]
    return [worded[d] for d in _filling([documents[d] for d in worded], packer)] + bare


def _filling(documents: list[np.ndarray], packer: Packer) -> list[int]:
    n, window = len(documents), packer.window
    if n < 3:
        return list(range(n))
    index = Index(documents, packer)
    lengths = np.fromiter(map(len, documents), np.int64, n)
    unused = np.ones(n, dtype=bool)
    placed: list[int] = []
    total = int(lengths.sum())
    ahead = filled = 0
    seed = -1
    found: list[int] = []
    while len(placed) < n:
        gap = (window - filled % window) % window
        choice = -1
        if gap:
            if not found:
                if 5 * (n - len(placed)) <= 4 * len(index.live):
                    index.narrow(unused)
                # As many as the gap takes of the mean length, so a window is asked for a few times only.
                most = max(packer.neighbours, -(-gap * (n - len(placed)) // (total - filled)))
                found = neighbours(index.scores(documents[seed]), unused, most)
            if found:
                choice = found.pop(next((i for i, d in enumerate(found) if lengths[d] <= gap), 0))
        if choice < 0:
            while not unused[ahead]:
                ahead += 1
            choice = ahead
        unused[choice] = False
        placed.append(choice)
        # Does it open a window, at its start or inside it?
        opens = not gap or lengths[choice] > gap
        filled += int(lengths[choice])
        if opens:
            seed, found = choice, []
    return placed


def neighbours(scores: np.ndarray, unused: np.ndarray, most: int) -> list[int]:
    scores = np.where(unused, scores, 0.0)
    top = np.argpartition(-scores, min(most, len(scores) - 1))[:most]
    top = top[scores[top] > 0]
    return top[np.lexsort((top, -scores[top]))].tolist()


def cuts(total: int, window: int) -> np.ndarray:
    """Where sequences begin and end in a stream of *total* ids."""
    ends = list(range(0, total - total % window + 1, window))
    rest = total % window
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            ends.append(ends[-1] + (1 << bit))
    return np.array(ends, dtype=np.int64)


def pieces(documents: list[np.ndarray], packer: Packer) -> tuple[list[np.ndarray], int]:
    """Columns (document, start, length, crc, sequence, offset) of a shard, and its sequences."""
    placed = np.array(order(documents, packer), dtype=np.int64)
    stream = np.concatenate([documents[d] for d in placed])
    lengths = np.fromiter((len(documents[d]) for d in placed), np.int64, len(placed))
    begins = np.concatenate([[0], np.cumsum(lengths)])
    ends = cuts(len(stream), packer.window)
    edges = np.union1d(begins, ends)
    at, size = edges[:-1], np.diff(edges)
    doc = np.searchsorted(begins, at, side="right") - 1
    sequence = np.searchsorted(ends, at, side="right") - 1
    data = memoryview(stream.tobytes())
    crc = [zlib.crc32(data[4 * a : 4 * (a + s)]) for a, s in zip(at.tolist(), size.tolist())]
    found = [placed[doc], at - begins[doc], size, np.array(crc, np.int64), sequence, at - ends[sequence]]
    return found, len(ends) - 1


COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def packed(docs: DataFrame, packer: Packer = Packer(), *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    schema = T.StructType(
        [T.StructField(key, docs.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in COLUMNS]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        cut = tokens(packer.vocabulary, packer.ranks)
        held: list[np.ndarray] = []
        keys: list[pa.Array] = []
        load = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, load
            (doc, start, length, crc, seq, offset), n = pieces(held, packer)
            whole = np.fromiter(map(len, held), np.int64, len(held))[doc]
            ids = pa.concat_arrays(keys).take(pa.array(doc))
            batch = pa.RecordBatch.from_arrays(
                [ids, *map(pa.array, (start, length, crc, whole, seq + sequence, offset))], [key, *COLUMNS]
            )
            sequence += n
            held.clear()
            keys.clear()
            load = 0
            return batch

        for batch in batches:
            ids, values = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                found = cut.ids(values[i].as_py() or "")
                if held and load + len(found) > packer.shard_tokens:
                    yield flush()
                held.append(found)
                keys.append(ids.slice(i, 1))
                load += len(found)
        if held:
            yield flush()

    slim = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text"))
    return slim.mapInArrow(run, schema)
