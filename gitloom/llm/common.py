"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "_row"
# Words are what lies between these six characters.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

BIG = 1 << 62


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key written as text, modulo *divisor*; a NULL key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A text column's values as UTF-8; NULL as the empty text."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def add_columns(
    frame: DataFrame, text: str, added: T.StructType, make: Callable[[list[bytes]], list[pa.Array]]
) -> DataFrame:
    """(_row, added…) per row: the untouched row as one struct beside what *make* finds in its text.

    The struct keeps the row's own columns apart from the added ones, so names cannot clash.
    """
    names = [f.name for f in added]
    schema = T.StructType([T.StructField(ROW, frame.schema), *added])
    at = frame.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            yield pa.RecordBatch.from_arrays([rows, *make(texts(rows.field(at)))], [ROW, *names])

    return frame.select(F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias(ROW)).mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes: texts and packed rows may be long, and a batch is held whole.

    Joins of these operators move rows by all their keys, as the sizes of their tasks rest on it.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
