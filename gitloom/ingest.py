"""The two ingest jobs: history from git, and definitions from the Python files in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitloom.functions.pysource import PRODUCER
from gitloom.operators import sync
from gitloom.operators.history import repository_totals
from gitloom.schemas import KEYS
from gitloom.operators.lifecycle import REPO
from gitloom.session import materialise
from gitloom.sources import git
from gitloom.sources.store import SCHEMA_VERSION, Store


HEAD_KEY = "head_sha:"


def analyze(spark: SparkSession, store: Store, roots: dict[str, str]) -> DataFrame:
    """Make the stored history of *roots* exactly what git holds. Returns the totals.

    A repository whose stored head is still in its history is read from there and
    its new commits are appended. Another is read whole and replaced: rows of
    commits that are gone go with them, definitions of the others stay.
    """
    repos = git.repositories(spark, roots)
    heads = store.read("meta").where(F.col("key").startswith(HEAD_KEY)).select(
        F.expr(f"substring(key, {len(HEAD_KEY) + 1})").alias(REPO), F.col("value").alias("since")
    )
    current = store.meta("schema_version") == SCHEMA_VERSION
    came = git.read_history(repos.join(heads, REPO, "left") if current else repos)
    came = {name: materialise(frame, f"came-{name}") for name, frame in came.items()}
    whole = came["read"].where("whole").select(REPO)
    if whole.limit(1).count():
        commits = came["commits"].join(whole, REPO, "left_semi")
        if sync.gone_commits(store.read("commits"), commits).limit(1).count():
            for table in ("file_versions", "definition_versions"):
                mine = store.read(table).join(whole, REPO, "left_semi")
                kept = materialise(sync.surviving(mine, commits), table)
                store.replace_repositories(table, kept, whole)
        for table in ("commits", "commit_parents", "commit_files"):
            store.replace_repositories(table, came[table].join(whole, REPO, "left_semi"), whole)
    grown = came["read"].where("not whole and n > 0").select(REPO)
    if grown.limit(1).count():
        for table in ("commit_parents", "commit_files", "commits"):
            # An append that stopped half way is finished, not repeated.
            new = came[table].join(grown, REPO, "left_semi")
            held = store.read(table).join(grown, REPO, "left_semi").select(*KEYS[table])
            store.append(table, materialise(new.join(held, KEYS[table], "left_anti"), f"new-{table}"))
    first = next(iter(roots.values()))
    tips = came["read"].select(F.concat(F.lit(HEAD_KEY), REPO).alias("key"), F.col("tip").alias("value"))
    store.set_meta({"schema_version": SCHEMA_VERSION, "repository_root": first}, tips)
    return repository_totals(store.read("commits"), store.read("commit_files"))


def parse(spark: SparkSession, store: Store, roots: dict[str, str]) -> DataFrame:
    """Read every Python version the lives hold. Contents already read are not read again.

    Only what differs is written: a repository with nothing but new versions gets them appended,
    one whose stored versions changed or went is written anew.
    """
    repos = git.repositories(spark, roots)
    mine = {t: store.read(t).join(repos, REPO, "left_semi") for t in ("commits", "commit_parents", "commit_files")}
    lives = sync.stored_lives(mine["commits"], mine["commit_files"], mine["commit_parents"])
    lives = sync.python_lives(lives).stored("lives")
    versions = materialise(sync.python_versions(lives.frame), "versions")
    stored = materialise(store.read("file_versions").join(repos, REPO, "left_semi"), "stored-versions")
    held = materialise(store.read("definition_versions").join(repos, REPO, "left_semi"), "stored-definitions")
    unread, tallies = sync.reuse_plan(versions, stored, PRODUCER)
    tallies = materialise(tallies, "tallies")
    parsed = materialise(git.parse_contents(unread.join(repos, REPO)), "parsed")
    file_versions, definitions = sync.ast_rows(
        lives, versions, parsed, sync.known_contents(stored, held, PRODUCER)
    )
    definitions = materialise(definitions, "definitions")
    # File versions last: they tell which contents are known.
    changes = [
        _brought(store, "definition_versions", held, definitions),
        _brought(store, "file_versions", stored, file_versions),
    ]
    failed = file_versions.groupBy(REPO).agg(F.count("parse_error").alias("failed"))
    counted = definitions.groupBy(REPO).agg(F.count(F.lit(1)).alias("definitions"))
    written = changes[0].unionByName(changes[1]).groupBy(REPO).agg(F.count(F.lit(1)).alias("changes"))
    for part in (failed, counted, written):
        tallies = tallies.join(part, REPO, "left")
    return tallies.fillna(0)


def _brought(store: Store, table: str, stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Make the table's *stored* rows the *incoming* ones. Returns (repo, act) of every row that differed."""
    incoming = store.shaped(table, incoming)
    changes = materialise(sync.version_changes(stored, incoming, KEYS[table]), f"changes-{table}")
    redone = changes.where("act <> 'new'").select(REPO).distinct()
    if not redone.isEmpty():
        store.replace_repositories(table, incoming.join(redone, REPO, "left_semi"), redone)
    new = changes.where("act = 'new'").join(redone, REPO, "left_anti")
    if not new.isEmpty():
        store.append(table, new)
    return changes.select(REPO, "act")
