"""Definition histories: what the readable versions of a file show, and the gaps."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gitloom.functions.text import enclosing_scope
from gitloom.operators.lifecycle import DELETED, REPO, SEQ
from gitloom.operators.sequence import Running, Sequence, running
from gitloom.session import materialise

READ, FAILED, NOT_STORED, NOT_IN_TREE, FILE_END = (
    "read", "parse_failed", "not_stored", "not_in_tree", "file_end",
)
LIFE = [REPO, "life_id"]
VERSION = [REPO, "commit_sha", "path"]
SLOT = ["kind", "qualname", "occurrence"]


@dataclass(frozen=True)
class DefinitionHistory:
    """``steps``: every version of every life. ``gaps``: the unread ones, under
    the step whose comparison spans them. ``events``: created, modified, deleted.
    ``lives``: one row per definition, with what stayed unresolved."""

    steps: DataFrame
    gaps: DataFrame
    events: DataFrame
    lives: DataFrame


def version_steps(lives: Sequence, versions: DataFrame) -> DataFrame:
    """Each event's state and ``step``, the running number of comparisons.

    A deletion that ends the file is a comparison against nothing, so it counts
    as a step without definitions; one in the middle is a gap.
    """
    stored = versions.select(*VERSION, F.lit(True).alias("_stored"), "parse_error")
    ends = lives.frame.groupBy(*LIFE).agg(F.max(SEQ).alias("_last"))
    gone = F.col("change_type") == DELETED
    state = (
        F.when(gone & (F.col(SEQ) == F.col("_last")), FILE_END)
        .when(gone, NOT_IN_TREE)
        .when(F.col("_stored").isNull(), NOT_STORED)
        .when(F.col("parse_error").isNotNull(), FAILED)
        .otherwise(READ)
    )
    told = (
        lives.frame.join(stored, VERSION, "left")
        .join(ends, LIFE, "left")
        .withColumn("state", state)
        .drop("_stored", "_last")
    )
    compared = F.col("state").isin(READ, FILE_END)
    steps = running(
        lives.of(told),
        LIFE,
        [
            Running("step", "sum", F.when(compared, 1).otherwise(0)),
            Running(
                "previous_commit_sha",
                "last",
                F.when(F.col("state") == READ, F.col("commit_sha")),
                before=True,
            ),
        ],
    )
    return materialise(steps, "steps")


def occurrences(definitions: DataFrame, position: list[str], within: list[str] = []) -> DataFrame:
    """Number the definitions that share a kind and a name inside one version.

    A version of one file bounds the rows of a key, so a window holds them. *within*: columns
    that tell apart the rows of a version that stands more than once.
    """
    same = Window.partitionBy(*VERSION, *within, "kind", "qualname").orderBy(*position)
    return definitions.withColumn("occurrence", (F.row_number().over(same) - 1).cast("long"))


def definition_history(
    lives: Sequence,
    versions: DataFrame,
    definitions: DataFrame,
    position: list[str] = ["position"],
) -> DefinitionHistory:
    steps = version_steps(lives, versions)
    gaps = steps.where(~F.col("state").isin(READ, FILE_END)).select(
        *LIFE, (F.col("step") + 1).alias("step"), SEQ, "commit_sha", "path", "state", "parse_error"
    )
    width = gaps.groupBy(*LIFE, "step").agg(F.count(F.lit(1)).alias("blind_spots"))
    # There are fewer steps than definitions, so what a step knows is put together there.
    compared = materialise(
        steps.where(F.col("state").isin(READ, FILE_END))
        .join(width, [*LIFE, "step"], "left")
        .select(
            *LIFE, "step", "commit_sha", "path", "previous_commit_sha", "state",
            F.coalesce("blind_spots", F.lit(0).cast("long")).alias("blind_spots"),
        ),
        "compared",
    )
    read = compared.where(F.col("state") == READ).drop("state")
    held = occurrences(definitions.join(read, VERSION), position, [*LIFE, "step"]).select(
        *LIFE, "step", *SLOT, "commit_sha", "path", "previous_commit_sha", "blind_spots",
        "fingerprint", "lineno", "end_lineno", "decorators",
    )
    # The versions of one definition, in order. What is not named is like nothing else.
    line = Window.partitionBy(*LIFE, *SLOT).orderBy("step")
    named = reduce(Column.__and__, [F.col(c).isNotNull() for c in [*LIFE, *SLOT]])
    follows = lambda step, other: F.coalesce(named & (step == other + 1), F.lit(False))
    told = materialise(
        held.withColumn("_was", follows(F.col("step"), F.lag("step").over(line)))
        .withColumn("_before", F.lag("fingerprint").over(line))
        .withColumn("_stays", follows(F.lead("step").over(line), F.col("step")))
        .where("not _was or not _stays or not (fingerprint <=> _before)"),
        "moved",
    )
    here = told.where("not _was or not (fingerprint <=> _before)").withColumn(
        "change", F.when(F.col("_was"), "modified").otherwise("created")
    )
    # A definition that is missing from a later comparison is gone; where there
    # is no later comparison nothing is known.
    gone = (
        told.where("not _stays")
        .select(*LIFE, (F.col("step") + 1).alias("step"), *SLOT)
        .join(compared.drop("state"), [*LIFE, "step"])
        .withColumn("change", F.lit("deleted"))
    )
    shown = [
        *LIFE, "step", *SLOT, "change", "commit_sha", "path", "previous_commit_sha",
        "lineno", "end_lineno", "decorators", "fingerprint", "blind_spots",
    ]
    events = here.select(*shown).unionByName(gone, allowMissingColumns=True).select(*shown)
    # The unread versions after the last comparison, per life that was ever read.
    last = compared.groupBy(*LIFE).agg(F.max("step").alias("_last"))
    tail = (
        last.withColumn("step", F.col("_last") + 1)
        .join(width, [*LIFE, "step"])
        .select(*LIFE, F.col("blind_spots").alias("_tail"))
    )
    ended = F.col("last_change") == "deleted"
    definition_lives = (
        events.groupBy(*LIFE, *SLOT)
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.min("step").alias("first_step"),
            F.max_by("change", "step").alias("last_change"),
            F.max_by("commit_sha", "step").alias("last_commit_sha"),
        )
        .join(tail, LIFE, "left")
        .withColumn(
            "unresolved",
            F.when(ended, F.lit(0).cast("long")).otherwise(F.coalesce("_tail", F.lit(0).cast("long"))),
        )
        .drop("_tail")
    )
    return DefinitionHistory(steps, gaps, events, definition_lives)


def kind_counts(definitions: DataFrame) -> DataFrame:
    """Definitions per version by kind, and how many of them are methods."""
    classes = (
        definitions.where(F.col("kind") == "class")
        .select(*VERSION, F.col("qualname").alias("_scope"), F.lit(1).alias("_in"))
        .distinct()
    )
    other = F.col("kind") != "class"
    scoped = definitions.withColumn("_scope", F.when(other, enclosing_scope(F.col("qualname"))))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return (
        scoped.join(classes, [*VERSION, "_scope"], "left")
        .groupBy(*VERSION)
        .agg(
            F.count(F.lit(1)).alias("definitions"),
            n(F.col("kind") == "class").alias("classes"),
            n(F.col("kind") == "function").alias("functions"),
            n(F.col("kind") == "async function").alias("async_functions"),
            n(F.col("_in").isNotNull()).alias("methods"),
        )
    )


def newest_versions(steps: DataFrame) -> DataFrame:
    """The newest version of each life: its state and what it was compared with."""
    return (
        steps.groupBy(*LIFE)
        .agg(
            F.max_by(
                F.struct("commit_sha", "path", "state", "parse_error", "previous_commit_sha"), SEQ
            ).alias("_v")
        )
        .select(*LIFE, "_v.*")
    )
