"""From raw documents to packed training sequences, in five stages.

Every stage reads what the one before it wrote. The first four keep the columns of documents and
drop or repeat rows; line deduplication also shortens texts. The last gives the pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitloom.llm import curriculum, line_dedup, packing, quality_bands, shingle_join
from gitloom.llm.common import ROW, small_batches, table
from gitloom.session import materialise, ship, tune


def _ready(spark: SparkSession) -> None:
    small_batches(tune(spark))
    ship(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    _ready(spark)
    return quality_bands.kept(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier, exactly or within one edit; emptied documents go."""
    _ready(spark)
    found = line_dedup.deduplicated(docs)
    bare = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fresh = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    changed = lambda c: F.when(F.col("n_removed") > 0, fresh[c]).otherwise(F.col(f"{ROW}.`{c}`"))
    columns = [changed(c).alias(c) if c in fresh else F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns]
    return found.filter(~F.coalesce(bare, F.lit(False))).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similar shingle sets link."""
    _ready(spark)
    return shingle_join.kept(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    _ready(spark)
    return curriculum.training_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of 2048-token sequences."""
    _ready(spark)
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("source mix", mix),
    ("packing", pack),
]

# zstandard ratios and token ids have no SQL form; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
