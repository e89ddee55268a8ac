"""Keeping the stored history exactly what git holds, and parsing only what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitloom.operators import structure as st
from gitloom.operators.lifecycle import (
    DELETED,
    REPO,
    change_events,
    lifecycle_events,
    sequence_events,
)
from gitloom.operators.sequence import Sequence
from gitloom.session import materialise

SHA = [REPO, "sha"]
VERSION = [REPO, "commit_sha", "path"]


def gone_commits(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored commits a rewrite removed. Only repositories that came in count."""
    seen = incoming.select(REPO).distinct()
    return stored.join(seen, REPO, "left_semi").select(*SHA).join(incoming.select(*SHA), SHA, "left_anti")


def new_commits(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return incoming.join(stored.select(*SHA), SHA, "left_anti")


def surviving(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows of *rows* (by commit_sha) whose commit is still there."""
    return rows.join(commits.select(REPO, F.col("sha").alias("commit_sha")), [REPO, "commit_sha"], "left_semi")


def changed_versions(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows that are new or differ from the stored ones in any column."""
    return version_changes(stored, incoming, keys).where("act <> 'gone'").select(*incoming.columns)


def version_changes(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """What turns the stored rows into the incoming ones: those rows, with ``act`` new, changed or gone.

    *keys* identify a row on either side. Of a row that is gone only the key is given.
    """
    held = [c for c in incoming.columns if c not in keys]
    sides = [f.select(*keys, F.struct(*held).alias(name)) for f, name in ((stored, "_old"), (incoming, "_new"))]
    act = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_new").isNull(), "gone")
        .when(F.col("_old") != F.col("_new"), "changed")
    )
    told = sides[0].join(sides[1], keys, "full_outer").withColumn("act", act).where("act is not null")
    return told.select(*keys, "_new.*", "act")


def stored_lives(commits: DataFrame, files: DataFrame, parents: DataFrame) -> Sequence:
    return lifecycle_events(sequence_events(change_events(commits, files, parents)))


def python_versions(lives: DataFrame) -> DataFrame:
    """The versions the parser reads: Python files that are there and hold content."""
    return lives.where(
        (F.col("change_type") != DELETED) & F.col("path").endswith(".py") & (F.col("mode") != "160000")
    ).select(*VERSION, F.col("blob_sha").alias("content_sha"))


def reuse_plan(versions: DataFrame, stored: DataFrame, producer: str) -> tuple[DataFrame, DataFrame]:
    """(contents that have to be parsed, tallies).

    A content is known when some stored version of the repository holds it and
    the same parser read it; each unknown content is parsed once, however many
    versions hold it.
    """
    known = (
        stored.where(F.col("parsed_at_version") == producer)
        .select(REPO, "content_sha")
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    contents = (
        versions.groupBy(REPO, "content_sha")
        .agg(F.count(F.lit(1)).alias("versions"))
        .join(known, [REPO, "content_sha"], "left")
    )
    tallies = contents.groupBy(REPO).agg(
        F.sum("versions").alias("file_versions"),
        F.coalesce(F.sum(F.when(F.col("_known"), F.col("versions"))), F.lit(0)).alias("reused"),
        F.count(F.when(F.col("_known").isNull(), 1)).alias("contents_to_parse"),
    )
    return contents.where("_known is null").select(REPO, "content_sha"), tallies


def known_contents(versions: DataFrame, definitions: DataFrame, producer: str) -> DataFrame:
    """Stored results by content, shaped like freshly parsed ones."""
    one = (
        versions.where(F.col("parsed_at_version") == producer)
        .groupBy(REPO, "content_sha", "parsed_at_version")
        .agg(F.min(F.struct("commit_sha", "path", "parse_error", "error_lineno", "error_offset")).alias("_v"))
        .select(REPO, "content_sha", "parsed_at_version", "_v.*")
    )
    return one, definitions.join(one.select(*VERSION, "content_sha"), VERSION).drop("commit_sha", "path", "change_type")


def ast_rows(
    lives: Sequence, versions: DataFrame, parsed: DataFrame, known: tuple[DataFrame, DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(file_versions, definition_versions) for every Python version of every life."""
    failure = ["parse_error", "error_lineno", "error_offset"]
    old, old_definitions = known
    results = parsed.select(REPO, "content_sha", "parsed_at_version", *failure).unionByName(
        old.select(REPO, "content_sha", "parsed_at_version", *failure)
    )
    file_versions = materialise(versions.join(results, [REPO, "content_sha"]), "file-versions")
    held = ["position", "kind", "qualname", "fingerprint", "lineno", "end_lineno", "decorators"]
    by_content = (
        parsed.select(REPO, "content_sha", F.explode("definitions").alias("_d"))
        .select(REPO, "content_sha", *[f"_d.{c}" for c in held])
        .unionByName(old_definitions.select(REPO, "content_sha", *held))
    )
    definitions = materialise(
        st.occurrences(
            file_versions.select(*VERSION, "content_sha").join(by_content, [REPO, "content_sha"]).drop("content_sha"),
            ["position"],
        ),
        "definitions",
    )
    changes = (
        st.definition_history(lives, file_versions, definitions.drop("occurrence"))
        .events.where("change <> 'deleted'")
        .select(*VERSION, "kind", "qualname", "occurrence", "change")
    )
    worded = definitions.join(changes, [*VERSION, "kind", "qualname", "occurrence"], "left").withColumn(
        "change_type", F.coalesce("change", F.lit("unchanged"))
    )
    return file_versions, worded.drop("occurrence", "change")


def python_lives(lives: Sequence) -> Sequence:
    """Lives that were a Python file at some time, with all their events."""
    ever = lives.frame.where(F.col("path").endswith(".py")).select(REPO, "life_id").distinct()
    return lives.of(lives.frame.join(ever, [REPO, "life_id"], "left_semi"))
