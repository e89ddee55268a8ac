"""Registered queries over the steps of ingest: listings, sync, reuse and table rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from gitloom import schemas
from gitloom.operators import sync
from gitloom.operators.lifecycle import REPO
from gitloom.plans import sqlviews as v
from gitloom.plans.registry import ctes, query
from gitloom.sources import adapters as a
from gitloom.sources.git import changed_files


@query(
    "raw_numstat_join",
    ctes(v.FILES)
    + "SELECT commit_sha, path, change_type, added_lines, deleted_lines FROM files",
)
def raw_numstat_join(spark, sf):
    """The changes told apart into git's two listings, and put together again."""
    files = a.commit_files(spark, sf).withColumnRenamed("commit_sha", "sha")
    none = F.lit(None)
    raw = files.select(
        REPO, "sha", F.lit("raw").alias("section"), "path", "old_path", "change_type", "similarity",
        none.cast("long").alias("added_lines"), none.cast("long").alias("deleted_lines"),
        F.lit("100644").alias("mode"), F.sha1(F.concat("sha", "path")).alias("blob_sha"),
    )
    counted = files.select(
        REPO, "sha", F.lit("numstat").alias("section"), "path", "old_path", none.cast("string").alias("change_type"),
        none.cast("int").alias("similarity"), "added_lines", "deleted_lines",
        none.cast("string").alias("mode"), none.cast("string").alias("blob_sha"),
    )
    return changed_files(raw.unionByName(counted)).select(
        "commit_sha", "path", "change_type", "added_lines", "deleted_lines"
    )


def _two_histories(spark, sf):
    """The store holds all but the P orders, git all but the F ones."""
    commits = a.commits(spark, sf)
    return commits.where("status <> 'P'"), commits.where("status <> 'F'")


@query("history_sync_gone", ctes(v.COMMITS) + "SELECT repo_id, sha FROM commits WHERE status = 'F'")
def history_sync_gone(spark, sf):
    return sync.gone_commits(*_two_histories(spark, sf))


@query("history_sync_new", ctes(v.COMMITS) + "SELECT sha, committed_epoch FROM commits WHERE status = 'P'")
def history_sync_new(spark, sf):
    return sync.new_commits(*_two_histories(spark, sf)).select("sha", "committed_epoch")


@query(
    "history_sync_surviving",
    ctes(v.COMMITS, v.FILES)
    + "SELECT commit_sha, path FROM files JOIN commits ON sha = commit_sha WHERE status <> 'F'",
)
def history_sync_surviving(spark, sf):
    _, incoming = _two_histories(spark, sf)
    return sync.surviving(a.commit_files(spark, sf), incoming).select("commit_sha", "path")


CONTENT = """
wanted AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 19, '0') AS commit_sha,
                  'p' || CAST(l_partkey AS VARCHAR) AS path, CAST(l_partkey AS VARCHAR) AS content,
                  max(l_returnflag) AS flag, max(l_linestatus) AS st
           FROM lineitem GROUP BY ALL),
known AS (SELECT DISTINCT content FROM wanted WHERE flag = 'R' AND st = 'F')"""


def _versions(spark, sf):
    """A part is a content; what was returned and finished was read before."""
    wanted = (
        a.table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_partkey")
        .agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("st"))
        .select(
            F.lit("orders").alias(REPO), a.key_text("l_orderkey").alias("commit_sha"),
            F.concat(F.lit("p"), "l_partkey").alias("path"), F.col("l_partkey").cast("string").alias("content_sha"),
            "flag", F.when(F.col("st") == "F", "3.13+1").otherwise("3.11+1").alias("parsed_at_version"),
        )
    )
    return wanted, wanted.where("flag = 'R'")


@query("reuse_plan", ctes(CONTENT) + "SELECT DISTINCT content AS content_sha FROM wanted WHERE content NOT IN (FROM known)")
def reuse_plan(spark, sf):
    unread, _ = sync.reuse_plan(*_versions(spark, sf), "3.13+1")
    return unread.select("content_sha")


@query(
    "reuse_tallies",
    ctes(CONTENT)
    + """SELECT 'orders' AS repo_id, count(*) AS file_versions,
           count(*) FILTER (WHERE content IN (FROM known)) AS reused,
           count(DISTINCT content) FILTER (WHERE content NOT IN (FROM known)) AS contents_to_parse FROM wanted""",
)
def reuse_tallies(spark, sf):
    return sync.reuse_plan(*_versions(spark, sf), "3.13+1")[1]


@query(
    "version_write_skip",
    ctes(v.STEPS)
    + """SELECT commit_sha, path FROM told
         WHERE (state <> 'not_stored' AND pr = '2-HIGH') OR (st = 'P' AND pr = '3-MEDIUM')""",
)
def version_write_skip(spark, sf):
    """High-priority versions are new to the store; medium ones fail with other words than before."""
    incoming = a.file_versions(spark, sf)
    priority = a.table(spark, sf, "orders").select(a.key_text("o_orderkey").alias("commit_sha"), "o_orderpriority")
    held = incoming.join(priority, "commit_sha").where("o_orderpriority <> '2-HIGH'")
    other = F.when(F.col("o_orderpriority") == "3-MEDIUM", F.upper("parse_error")).otherwise(F.col("parse_error"))
    stored = held.withColumn("parse_error", other).drop("o_orderpriority")
    return sync.changed_versions(stored, incoming, [REPO, "commit_sha", "path"]).select("commit_sha", "path")


@query(
    "table_violations",
    """WITH rows_ AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 19, '0') AS commit_sha,
                        's' || CAST(l_suppkey AS VARCHAR) AS path, l_returnflag AS letter,
                        CASE WHEN l_tax = 0 THEN NULL ELSE 1 END AS a FROM lineitem),
       found AS (
         SELECT 'change_type' AS rule, commit_sha, path, 1 AS n FROM rows_ WHERE letter NOT IN ('A', 'R')
         UNION ALL SELECT 'line_counts', commit_sha, path, 1 FROM rows_ WHERE a IS NULL
         UNION ALL SELECT 'unique', commit_sha, path, count(*) FROM rows_ GROUP BY ALL HAVING count(*) > 1)
       SELECT rule, 'orders|' || commit_sha || '|' || path AS key, CAST(n AS BIGINT) AS rows FROM found""",
)
def table_violations(spark, sf):
    """Lines taken as changes as they are: repeated keys, unknown letters, one count without the other."""
    rows = a.table(spark, sf, "lineitem").select(
        F.lit("orders").alias(REPO), a.key_text("l_orderkey").alias("commit_sha"),
        F.concat(F.lit("s"), "l_suppkey").alias("path"), F.lit(None).cast("string").alias("old_path"),
        F.col("l_returnflag").alias("change_type"), F.when(F.col("l_tax") != 0, 1).cast("long").alias("added_lines"),
        F.lit(1).cast("long").alias("deleted_lines"), F.lit(None).cast("int").alias("similarity"),
    )
    return schemas.violations("commit_files", rows)
