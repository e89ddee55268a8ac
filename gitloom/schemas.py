"""Table shapes, and the constraints Parquet cannot enforce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMMITS = (
    "repo_id string, sha string, author_name string, author_email string,"
    " authored_at string, committed_at string, committed_epoch bigint, message string"
)
COMMIT_PARENTS = "repo_id string, commit_sha string, position int, parent_sha string"
COMMIT_FILES = (
    "repo_id string, commit_sha string, path string, old_path string, change_type string,"
    " added_lines bigint, deleted_lines bigint, similarity int, mode string, blob_sha string"
)
FILE_VERSIONS = (
    "repo_id string, commit_sha string, path string, content_sha string,"
    " parsed_at_version string, parse_error string, error_lineno int, error_offset int"
)
DEFINITION_VERSIONS = (
    "repo_id string, commit_sha string, path string, position int, kind string,"
    " qualname string, change_type string, fingerprint string, lineno int, end_lineno int,"
    " decorators array<string>"
)
MEMORIES = (
    "memory_id string, repository_path string, statement string, author_name string,"
    " author_email string, admitted_at string, admitted_epoch bigint, subject_kind string,"
    " subject_path string, subject_qualname string, subject_commit_sha string,"
    " since_commit_sha string, since_date string, state string, ended_at string,"
    " ended_epoch bigint, end_reason string, superseded_by string, act_no bigint"
)
MEMORY_CITATIONS = "memory_id string, position int, kind string, ref string"
EXPLAIN_RUNS = (
    "run_no bigint, unit_kind string, unit_spec string, bundle_sha256 string,"
    " provider string, model string, prompt_sha256 string, created_at string"
)
META = "key string, value string"

TABLES = {
    "commits": COMMITS,
    "commit_parents": COMMIT_PARENTS,
    "commit_files": COMMIT_FILES,
    "file_versions": FILE_VERSIONS,
    "definition_versions": DEFINITION_VERSIONS,
    "memories": MEMORIES,
    "memory_citations": MEMORY_CITATIONS,
    "explain_runs": EXPLAIN_RUNS,
    "meta": META,
}

# The words and letters the stored rows may hold.
CHANGE_LETTERS = ["A", "C", "D", "M", "R", "T", "U", "X", "B"]
DEFINITION_KINDS = ["function", "async function", "class"]
DEFINITION_CHANGES = ["created", "modified", "unchanged", "deleted"]
CITATION_KINDS = ["commit", "file", "definition", "range", "cochange", "absence"]
SUBJECT_KINDS = ["repository", "path", "definition", "commit"]
MEMORY_STATES = ["active", "superseded", "invalidated"]

KEYS = {
    "commits": ["repo_id", "sha"],
    "commit_parents": ["repo_id", "commit_sha", "position"],
    "commit_files": ["repo_id", "commit_sha", "path"],
    "file_versions": ["repo_id", "commit_sha", "path"],
    "definition_versions": ["repo_id", "commit_sha", "path", "position"],
    "memories": ["memory_id", "act_no"],
    "memory_citations": ["memory_id", "kind", "ref"],
}

# table -> (rule, SQL predicate a good row satisfies)
CHECKS = {
    "commit_files": [
        ("change_type", f"change_type IN ({', '.join(map(repr, CHANGE_LETTERS))})"),
        ("similarity", "similarity IS NULL OR similarity BETWEEN 0 AND 100"),
        ("line_counts", "(added_lines IS NULL) = (deleted_lines IS NULL)"),
    ],
    "definition_versions": [
        ("kind", f"kind IN ({', '.join(map(repr, DEFINITION_KINDS))})"),
        ("change_type", f"change_type IN ({', '.join(map(repr, DEFINITION_CHANGES[:3]))})"),
    ],
    "memories": [
        ("state", f"state IN ({', '.join(map(repr, MEMORY_STATES))})"),
        ("statement", "length(trim(statement)) BETWEEN 1 AND 4000"),
        ("since", "since_commit_sha IS NULL OR since_date IS NULL"),
        ("ended", "(state = 'active') = (ended_at IS NULL)"),
    ],
    "memory_citations": [
        ("kind", f"kind IN ({', '.join(map(repr, CITATION_KINDS))})"),
    ],
}


def violations(table: str, frame: DataFrame) -> DataFrame:
    """Rows breaking the table's rules: (rule, key, rows)."""
    keys = KEYS.get(table, frame.columns)
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key")
    found = [
        frame.where(~F.coalesce(F.expr(predicate), F.lit(False))).select(
            F.lit(rule).alias("rule"), key, F.lit(1).cast("long").alias("rows")
        )
        for rule, predicate in CHECKS.get(table, [])
    ]
    found.append(
        frame.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
        .select(F.lit("unique").alias("rule"), key, "rows")
    )
    return reduce(DataFrame.unionByName, found)
