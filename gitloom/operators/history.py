"""Commit-level views: timeline, totals, lookups, name against identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitloom.functions.text import first_line
from gitloom.operators.lifecycle import REPO, lives_of_path

NEWEST = ("committed_epoch", "sha")


def newest_first(commits: DataFrame) -> DataFrame:
    """Newest first; the sha settles equal seconds, so the order is one order."""
    return commits.orderBy(F.desc("committed_epoch"), "sha")


def timeline(commits: DataFrame, files: DataFrame, *, limit: int | None = 20) -> DataFrame:
    """One row per commit, newest first.

    With a limit the commits are cut first, and only their files are counted.
    """
    kept = newest_first(commits)
    if limit is not None:
        kept = kept.limit(limit)
        # At most *limit* rows.
        files = files.join(
            F.broadcast(kept.select(REPO, F.col("sha").alias("commit_sha"))),
            [REPO, "commit_sha"],
            "left_semi",
        )
    counted = files.groupBy(REPO, F.col("commit_sha").alias("sha")).agg(
        F.count(F.lit(1)).alias("_files"),
        F.sum("added_lines").alias("_in"),
        F.sum("deleted_lines").alias("_out"),
    )
    zero = F.lit(0).cast("long")
    rows = kept.join(counted, [REPO, "sha"], "left").select(
        "sha",
        F.substring("committed_at", 1, 10).alias("date"),
        F.col("author_name").alias("author"),
        F.coalesce("_files", zero).alias("files_changed"),
        F.coalesce("_in", zero).alias("insertions"),
        F.coalesce("_out", zero).alias("deletions"),
        first_line(F.col("message")).alias("message"),
        "committed_epoch",
    )
    return newest_first(rows)


def repository_totals(commits: DataFrame, files: DataFrame) -> DataFrame:
    span = commits.groupBy(REPO).agg(
        F.count(F.lit(1)).alias("commits"),
        F.min("committed_epoch").alias("first_epoch"),
        F.max("committed_epoch").alias("last_epoch"),
    )
    changes = files.groupBy(REPO).agg(F.count(F.lit(1)).alias("file_changes"))
    return span.join(changes, REPO, "left").withColumn(
        "file_changes", F.coalesce("file_changes", F.lit(0).cast("long"))
    )


def merges(parents: DataFrame) -> DataFrame:
    return (
        parents.groupBy(REPO, "commit_sha")
        .agg(F.count(F.lit(1)).alias("parents"))
        .where("parents > 1")
    )


def commits_with_prefix(commits: DataFrame, prefix: str) -> DataFrame:
    if not prefix or any(c not in "0123456789abcdefABCDEF" for c in prefix):
        raise ValueError(f"not a commit prefix: {prefix!r}")
    return newest_first(commits.where(F.col("sha").startswith(prefix.lower())))


def prefix_answer(resolved: DataFrame) -> DataFrame:
    """What each resolved prefix (of any length) names: not_found, found or ambiguous."""
    n = F.coalesce("candidates", F.lit(0)).cast("long")
    return resolved.select(
        F.col("ref").alias("prefix"),
        n.alias("candidates"),
        F.when(n == 0, "not_found").when(n == 1, "found").otherwise("ambiguous").alias("answer"),
        F.when(n == 1, F.col("sha")).alias("sha"),
    )


def commits_touching(files: DataFrame, path: str) -> DataFrame:
    """The name view: commits with a change under that name, either side of a rename."""
    at = (F.col("path") == path) | (F.col("old_path") == path)
    return files.where(at).select(REPO, "commit_sha").distinct()


def commits_of(events: DataFrame, path: str) -> DataFrame:
    """The identity view: commits of every life that ever carried the name."""
    lives = lives_of_path(events, path)
    return events.join(lives, [REPO, "life_id"], "left_semi").select(REPO, "commit_sha").distinct()


def name_against_identity(events: DataFrame, path: str) -> DataFrame:
    by_name = commits_touching(events, path).withColumn("by_name", F.lit(True))
    by_identity = commits_of(events, path).withColumn("by_identity", F.lit(True))
    no = F.lit(False)
    return by_name.join(by_identity, [REPO, "commit_sha"], "full").select(
        REPO,
        "commit_sha",
        F.coalesce("by_name", no).alias("by_name"),
        F.coalesce("by_identity", no).alias("by_identity"),
    )


# The word for each change letter.
CHANGE_WORDS = {
    "A": "added",
    "C": "copied",
    "D": "deleted",
    "M": "modified",
    "R": "renamed",
    "T": "type changed",
    "U": "unmerged",
    "X": "unknown",
}


def change_word(letter: Column) -> Column:
    words = F.create_map(*[F.lit(v) for pair in CHANGE_WORDS.items() for v in pair])
    return F.coalesce(words[letter], letter)


def line_counters() -> Column:
    """``+12/-3``, or ``-`` for a binary file."""
    binary = F.col("added_lines").isNull() & F.col("deleted_lines").isNull()
    return F.when(binary, "-").otherwise(F.format_string("+%d/-%d", "added_lines", "deleted_lines"))


def shown_path() -> Column:
    arrow = F.concat(F.col("old_path"), F.lit(" \u2192 "), F.col("path"))
    return F.coalesce(arrow, F.col("path"))


def commit_detail(commits: DataFrame, files: DataFrame, prefix: str) -> DataFrame:
    """A commit's changes by path. The prefix has to name exactly one commit."""
    found = commits_with_prefix(commits, prefix).select(REPO, F.col("sha").alias("commit_sha")).limit(6).collect()
    if len(found) != 1:
        listed = ", ".join(r["commit_sha"][:12] for r in found[:5])
        raise LookupError(f"{prefix} is ambiguous: {listed}" if found else f"no commit {prefix}")
    sha = found[0]["commit_sha"]
    return (
        files.where(F.col("commit_sha") == sha)
        .select(
            "commit_sha",
            "path",
            shown_path().alias("shown_path"),
            change_word(F.col("change_type")).alias("change"),
            line_counters().alias("lines"),
            "similarity",
        )
        .orderBy("path")
    )
