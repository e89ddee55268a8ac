"""Ordered computation that does not depend on how large one key is.

A window over ``partitionBy(key)`` puts a whole key into one task. That is done for
keys of up to ``CROWDED`` rows. Rows are placed by range over the *full* order, so a
larger key spans many ranges; there each range is folded on its own, the per-range
results are folded in a second step, and the carry is joined back. Only crowded keys
have such results: one per key and range would grow with keys times ranges.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gitloom.session import materialise

CHUNK = "_chunk"
SEQ = "seq"

# What one range holds.
CHUNK_ROWS = 1 << 20
# A key with more rows is folded by range.
CROWDED = 1 << 18


@dataclass(frozen=True)
class Sequence:
    """Rows carrying a unique, order-preserving ``seq`` and the range they are in.

    ``rows`` and ``table``: how many there were at first, and those as a table, if known.
    ``decided`` names the column whose value another column's decides; keys of ``narrow``
    columns are known not to be crowded.
    """

    frame: DataFrame
    rows: int | None = None
    table: DataFrame | None = None
    decided: dict[str, str] = field(default_factory=dict)
    narrow: tuple[str, ...] = ()

    def of(self, frame: DataFrame) -> "Sequence":
        """The same ordering over rows derived from these."""
        return replace(self, frame=frame)

    def stored(self, name: str) -> "Sequence":
        """The same rows as a table, for plans that read them more than once."""
        return self.of(materialise(self.frame, name))


def ordered(frame: DataFrame, by: list[str], *, ranges: int | None = None, written: bool = False) -> Sequence:
    """Give every row its 1-based position ``seq`` in the total order *by*.

    *by* has to identify a row. Rows are placed by range over the whole order, so
    no task sorts more than its range; the ranges' row counts then turn the
    position inside a range into the position overall. The rows are written and
    counted first: there is a range for every ``CHUNK_ROWS`` of them, and one for
    every core at least. ``ranges`` sets their number instead. *written*: *frame* is
    a table already.
    """
    stored = frame if written else materialise(frame, "unordered")
    cores = frame.sparkSession.sparkContext.defaultParallelism
    rows = stored.count()
    n = ranges or max(cores, -(-rows // CHUNK_ROWS))
    spread = stored.repartitionByRange(n, *by)
    numbered = (
        spread.sortWithinPartitions(*by)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn(CHUNK, F.spark_partition_id())
    )
    fixed = materialise(numbered, "ordered")
    # One row per range, whatever the data holds.
    sizes = fixed.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_rows")).orderBy(CHUNK).collect()
    total, offsets = 0, []
    for row in sizes:
        offsets.append((row[CHUNK], total))
        total += row["_rows"]
    # A range's ids start at its partition number shifted by 33 bits.
    inside = F.col("_id") - F.shiftleft(F.col(CHUNK).cast("long"), 33) + 1
    table = frame.sparkSession.createDataFrame(offsets, f"{CHUNK} int, _offset long")
    positioned = fixed.join(F.broadcast(table), CHUNK).withColumn(SEQ, inside + F.col("_offset"))
    return Sequence(positioned.select(*frame.columns, SEQ, CHUNK), rows, stored)


def positioned(frame: DataFrame, position: str, *, chunk_rows: int = CHUNK_ROWS) -> Sequence:
    """Use a unique integer the rows already carry as their position.

    Ranges are equal steps of that integer, so each holds a bounded number of
    rows and nothing has to be sorted or written.
    """
    chunk = F.floor(F.col(position) / chunk_rows).cast("int")
    return Sequence(frame.withColumn(SEQ, F.col(position)).withColumn(CHUNK, chunk))


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is last, sum, min or count.

    ``before`` leaves the row itself out. ``last`` skips NULLs.
    """

    name: str
    kind: str
    value: Column
    before: bool = False


def _over(item: Running, window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, -1 if item.before else 0)
    if item.kind == "last":
        return F.last(item.value, ignorenulls=True).over(frame)
    if item.kind == "min":
        return F.min(item.value).over(frame)
    if item.kind == "sum":
        return F.coalesce(F.sum(item.value).over(frame), F.lit(0))
    if item.kind == "count":
        return F.count(item.value).over(frame)
    raise ValueError(item.kind)


def _whole(item: Running, order: list[str]) -> Column:
    if item.kind == "last":
        position = F.struct(*order)
        return F.max_by(item.value, F.when(item.value.isNotNull(), position))
    return {"min": F.min, "sum": F.sum, "count": F.count}[item.kind](item.value)


def _carried(item: Running, before) -> Column:
    source = F.col(f"_w_{item.name}")
    if item.kind == "last":
        return F.last(source, ignorenulls=True).over(before)
    if item.kind == "min":
        return F.min(source).over(before)
    return F.sum(source).over(before)


def _merged(item: Running) -> Column:
    local, carry = F.col(item.name), F.col(f"_c_{item.name}")
    if item.kind == "last":
        return F.coalesce(local, carry)
    if item.kind == "min":
        return F.least(local, carry)
    return local + F.coalesce(carry, F.lit(0))


def crowded(sequence: Sequence, keys: list[str]) -> list:
    """The keys of more than ``CROWDED`` rows: at most one for so many rows of the whole."""
    if any(k in sequence.narrow for k in keys) or (sequence.rows is not None and sequence.rows <= CROWDED):
        return []
    # Counted in the table where that has the keys: the frame may cost joins and folds.
    table = sequence.table
    known = table is not None and set(keys) <= set(table.columns)
    counted = (table if known else sequence.frame).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counted.where(F.col("_rows") > CROWDED).select(*keys).collect()


def running(
    sequence: Sequence, keys: list[str], items: list[Running], order: list[str] | None = None
) -> DataFrame:
    """Add running values per *keys*, in sequence order. Rows with a NULL key are left out."""
    order = order or [SEQ]
    busy = crowded(sequence, keys)
    keys = [*keys, *(sequence.decided[k] for k in keys if k in sequence.decided and sequence.decided[k] not in keys)]
    named = reduce(Column.__and__, [F.col(k).isNotNull() for k in [*keys, CHUNK]])
    frame = sequence.frame.where(named)
    columns = [c for c in frame.columns if c not in {i.name for i in items}]
    if not busy:
        window = Window.partitionBy(*keys).orderBy(*order)
        return frame.select(*columns, *[_over(i, window).alias(i.name) for i in items])
    spark = frame.sparkSession
    hot = list(busy[0].asDict())
    schema = sequence.frame.select(*hot).schema
    marked = frame.join(
        F.broadcast(spark.createDataFrame(busy, schema).withColumn("_hot", F.lit(True))), hot, "left"
    ).withColumn("_part", F.when(F.col("_hot"), F.col(CHUNK)).otherwise(-1))
    window = Window.partitionBy(*keys, "_part").orderBy(*order)
    local = marked.select("*", *[_over(i, window).alias(i.name) for i in items])
    totals = marked.where("_hot").groupBy(*keys, "_part").agg(
        *[_whole(i, order).alias(f"_w_{i.name}") for i in items]
    )
    before = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per crowded key and range.
    carry = totals.select(
        *keys, "_part", *[_carried(i, before).alias(f"_c_{i.name}") for i in items]
    )
    joined = local.join(carry, [*keys, "_part"], "left")
    return joined.select(*columns, *[_merged(i).alias(i.name) for i in items])
