"""Mixing sources to target weights with a curriculum that changes over training.

A source's weight is a piecewise linear schedule over training time 0..1. Its integral is the
source's share of all words; the integral up to t, scaled to the source's target, is how many of
its words training has asked for by then. A document is placed where that demand reaches the
middle of its words: the schedule is integrated once per source (one row each) and inverted per
document. Sorting by position gives the training order, by range, so no task holds it all.

Targets: the budget is a share of all words, dealt out by weight; a source stops at a multiple of
its own words and its excess goes to the others by weight until none is above.

A source's documents are taken in a random but fixed order (md5 of a seed, the id and the text). All of them
are taken as often as the target allows, and the first ones of the order once more, up to the
document whose middle passes what is left: a source misses its target by half a document at most.
The running sum inside a source is two-level (per slice of the order, then over the slices), so a
source with a third of all rows is spread over as many tasks as it has slices.

NULL source: a source of its own, last in order. NULL or empty text: size 0, taken 0, and its
copies stand where the next document begins. Rows equal in id and text are
interchangeable. An empty table gives an empty table; a source without words has target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gitloom.llm.common import ROW, word_count

# Knots (time, factor) of a schedule; factors are scaled so that the integral is 1.
EARLY = ((0.0, 1.5), (1.0, 0.5))
EVEN = ((0.0, 1.0), (1.0, 1.0))
LATE = ((0.0, 0.5), (0.7, 1.0), (1.0, 2.0))

WEIGHTS = (5.0, 2.0, 1.0)
SCHEDULES = (EARLY, EVEN, LATE)
# Hexadecimal digits of the order's hash that name a slice: 4096 slices a source.
SLICE_DIGITS = 3


def integral(knots: Sequence[tuple[float, float]]) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def invert(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which *share* (0..1) of a schedule's words has been asked for."""
    whole = integral(knots)
    done, result = 0.0, F.lit(float(knots[-1][0]))
    pieces = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (w0 + w1) / 2 / whole
        pieces.append((done, done + area, t0, t1, w0 / whole, w1 / whole))
        done += area
    for low, high, t0, t1, w0, w1 in reversed(pieces):
        need = F.greatest(share - F.lit(low), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        if abs(slope) < 1e-12:
            t = F.lit(t0) + need / F.lit(w0) if w0 else F.lit(t1)
        else:
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + need * F.lit(2 * slope), F.lit(0.0)))
            t = F.lit(t0) + (root - F.lit(w0)) / F.lit(slope)
        result = F.when(share < F.lit(high), F.least(t, F.lit(t1))).otherwise(result)
    return result


def targets(sizes: DataFrame, weights: Sequence[float], budget: float, most: float) -> DataFrame:
    """(source, source_size, place, target) from (source, size): one row per source.

    Filling by weight stops sources in the order of (limit / weight), so one running sum over the
    sources finds the level at which the others settle. The window holds one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    placed = per_source.withColumn("place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    ready = placed.select(
        "source",
        "source_size",
        "place",
        weight.alias("w"),
        (F.sum("source_size").over(everything) * F.lit(budget)).alias("b"),
    ).withColumn("ratio", F.col("source_size") * F.lit(most) / F.col("w"))
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("b") - F.coalesce(F.sum(F.col("source_size") * F.lit(most)).over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    leveled = ready.withColumn("level", level)
    # The first source that stays under its limit sets the level for all after it.
    settled = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything)
    earlier = (F.col("ratio") < settled["ratio"]) | (
        (F.col("ratio") == settled["ratio"]) & (F.col("place") < settled["place"])
    )
    stops = settled.isNull() | earlier
    return leveled.select(
        "source",
        "source_size",
        "place",
        F.when(stops, F.col("source_size") * F.lit(most)).otherwise(F.col("w") * settled["level"]).alias("target"),
    )


def mixed(
    docs: DataFrame,
    *,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence = SCHEDULES,
    budget: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    keep_rows: bool = True,
) -> DataFrame:
    """One row per document: (_row, size, source_size, target, copies, taken, positions).

    *positions* has the training time of each copy taken, 0..1. Source number i (by code point)
    has weight and schedule i modulo their counts.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep_rows else F.struct(F.col(f"`{key}`"))
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sized = docs.select(
        row.alias(ROW),
        F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), content).cast("binary")).alias("h"),
    )
    slim = sized.select("source", "size", F.substring("h", 1, SLICE_DIGITS).alias("slice"))
    sums = slim.groupBy("source", "slice").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    plan = targets(sums, weights, budget, most)
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("s"),
        F.col("slice").alias("sl"),
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"),
    ).join(plan, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    sliced = sized.withColumn("slice", F.substring("h", 1, SLICE_DIGITS))
    joined = sliced.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("sl")))
    inside = Window.partitionBy("s", "sl").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    again = (F.col("size") > 0) & (F.col("offset") + F.col("size") / 2 <= rest)
    counted = (
        joined.withColumn("offset", offset)
        .withColumn("passes", passes.cast("int"))
        .withColumn("copies", F.col("passes") + again.cast("int"))
        .withColumn("taken", F.col("size") * F.col("copies"))
    )
    share = lambda i: F.least(
        (i * F.col("source_size") + F.col("offset") + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1e-9)),
        F.lit(1.0),
    )
    kind = F.col("place") % len(schedules)
    at = lambda i: F.coalesce(*[F.when(kind == n, invert(share(i), k)) for n, k in enumerate(schedules)])
    copies = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    return counted.select(
        ROW, "size", "source_size", "target", "copies", "taken", F.transform(copies, at).alias("positions")
    )


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of *docs*, each as often as it is taken, range-sorted by training position."""
    copies = mixed(docs, **options).select(ROW, F.posexplode("positions").alias("copy", "position"))
    key = options.get("key", "doc_id")
    spread = copies.repartitionByRange("position", F.col(f"{ROW}.`{key}`"), "copy")
    return spread.sortWithinPartitions("position", F.col(f"{ROW}.`{key}`"), "copy").select(f"{ROW}.*")


def by_first_position(mixed: DataFrame, key: str) -> DataFrame:
    """What ``mixed`` gives, range-sorted by each document's first position; those without one last."""
    order = [F.get("positions", F.lit(0)).asc_nulls_last(), F.col(f"{ROW}.`{key}`").asc()]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)
