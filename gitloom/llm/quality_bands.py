"""Quality rules by compression bands.

zstandard's ratio (compressed bytes over bytes) tells repetitive text (low) and text without
structure, such as encoded data (high), from prose. Prose gets denser as it gets longer, so each
length has limits of its own. The ratio is taken over the whole document and over fixed chunks: a
document that is fine on the whole may still hold long stretches that are not. The chunks cover
every byte: a short rest has the limits of its own length, a very short one goes with its neighbour.

Every row is judged by itself, in one pass without a shuffle. NULL and empty texts have no words
and fail the base rules; a text too short for any band is judged by the base rules alone. A long text
is judged chunk by chunk, whole. Ties do not arise; columns of *docs* stay inside ``_row``; repeated rows get the same verdict each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gitloom.llm.common import ROW, add_columns

SYMBOLS = "#*$%&|<>"

ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("bad_chunk_bytes", T.LongType()),
        T.StructField("chunk_bytes", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Bands:
    """(from how many bytes, lowest ratio, highest ratio), shortest first; below the first: no limits."""

    limits: Sequence[tuple[int, float, float]] = (
        (256, 0.32, 0.95),
        (512, 0.28, 0.85),
        (1024, 0.25, 0.74),
        (4096, 0.20, 0.68),
        (16384, 0.15, 0.65),
    )
    level: int = 3
    chunk: int = 2048
    # A last chunk shorter than this is judged together with the one before it.
    least_chunk: int = 256
    # Of the chunks' bytes, the share that may lie outside the limits.
    bad_share: float = 0.3
    min_words: int = 50
    repeat_percent: int = 50

    def inside(self, size: int, ratio: float) -> bool:
        for start, low, high in reversed(self.limits):
            if size >= start:
                return low <= ratio <= high
        return True


@dataclass
class _Measure:
    bands: Bands
    packer: zstandard.ZstdCompressor = field(init=False)

    def __post_init__(self):
        self.packer = zstandard.ZstdCompressor(level=self.bands.level, write_content_size=False)

    def ratio(self, data: bytes) -> float:
        return len(self.packer.compress(data)) / len(data) if data else 0.0

    def of(self, data: bytes) -> tuple:
        words = data.split()
        held = sum(map(len, words))
        points = len(data.decode("utf-8", "replace")) - (len(data) - held)
        symbols = sum(data.count(s) for s in SYMBOLS.encode())
        lines = [line for line in data.split(b"\n") if line.strip()]
        size, step = len(data), self.bands.chunk
        starts = list(range(0, size, step))
        if len(starts) > 1 and size - starts[-1] < self.bands.least_chunk:
            starts.pop()
        bad = 0
        for start, end in zip(starts, [*starts[1:], size]):
            if not self.bands.inside(end - start, self.ratio(data[start:end])):
                bad += end - start
        return (
            len(words),
            points,
            symbols,
            len(lines) - len(set(lines)),
            repeat_words(words),
            self.ratio(data),
            size,
            bad,
            size,
        )


def repeat_words(words: list[bytes]) -> int:
    """Words inside some window of three words that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    first: dict = {}
    twice = bytearray(len(windows))
    for at, window in enumerate(windows):
        before = first.setdefault(window, at)
        if before != at:
            twice[before] = twice[at] = 1
    covered = bytearray(len(words))
    for at, again in enumerate(twice):
        if again:
            covered[at] = covered[at + 1] = covered[at + 2] = 1
    return sum(covered)


def measured(docs: DataFrame, bands: Bands = Bands(), *, text: str = "text") -> DataFrame:
    """(_row, measures, base_failed, kept) for every row of *docs*."""

    def make(values: list[bytes]) -> list[pa.Array]:
        measure = _Measure(bands)
        rows = [measure.of(v) for v in values]
        columns = list(zip(*rows)) if rows else [[] for _ in ADDED]
        kinds = [pa.float64() if f.name == "ratio" else pa.int64() for f in ADDED]
        return [pa.array(c, k) for c, k in zip(columns, kinds)]

    found = add_columns(docs, text, ADDED, make)
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < bands.min_words) | (repeated * 100 > n * bands.repeat_percent)
    whole = _inside(bands, F.col("n_bytes"), F.col("ratio"))
    chunks = F.col("bad_chunk_bytes") <= F.col("chunk_bytes") * F.lit(bands.bad_share)
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & whole & chunks)


def _inside(bands: Bands, size: Column, ratio: Column) -> Column:
    verdict = F.lit(True)
    for start, low, high in bands.limits:
        verdict = F.when(size >= start, ratio.between(low, high)).otherwise(verdict)
    return verdict


def kept(docs: DataFrame, bands: Bands = Bands(), *, text: str = "text") -> DataFrame:
    """The rows of *docs* that pass, with exactly their columns."""
    return measured(docs, bands, text=text).filter("kept").select(f"{ROW}.*")
