"""Registered queries over commits, identities, co-change and definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gitloom.operators import cochange as cc
from gitloom.operators import history as h
from gitloom.operators import lifecycle as lc
from gitloom.operators import memory as m
from gitloom.operators import structure as st
from gitloom.operators.lifecycle import SEQ
from gitloom.operators.sequence import ordered
from gitloom.plans import sqlviews as v
from gitloom.plans.registry import ctes, query
from gitloom.session import materialise
from gitloom.sources import adapters as a

# ------------------------------------------------------------------ commits

TIMELINE = """
SELECT c.sha, substring(committed_at, 1, 10) AS date, author_name AS author,
       count(f.path) AS files_changed, CAST(coalesce(sum(added_lines), 0) AS BIGINT) AS insertions,
       CAST(coalesce(sum(deleted_lines), 0) AS BIGINT) AS deletions, message,
       c.committed_epoch
FROM commits c LEFT JOIN files f ON f.commit_sha = c.sha
GROUP BY c.sha, committed_at, author_name, message, c.committed_epoch
"""


@query("timeline", ctes(v.COMMITS, v.FILES) + TIMELINE)
def timeline(spark, sf):
    return h.timeline(a.commits(spark, sf), a.commit_files(spark, sf), limit=None)


@query("timeline_latest", ctes(v.COMMITS, v.FILES) + TIMELINE + "ORDER BY c.committed_epoch DESC, c.sha LIMIT 20")
def timeline_latest(spark, sf):
    return h.timeline(a.commits(spark, sf), a.commit_files(spark, sf), limit=20)


@query(
    "repo_totals",
    ctes(v.COMMITS, v.FILES)
    + """SELECT repo_id, count(*) AS commits, min(committed_epoch) AS first_epoch,
           max(committed_epoch) AS last_epoch, (SELECT count(*) FROM files) AS file_changes
         FROM commits GROUP BY repo_id""",
)
def repo_totals(spark, sf):
    return h.repository_totals(a.commits(spark, sf), a.commit_files(spark, sf))


@query(
    "merge_commits",
    ctes(v.COMMITS, v.PARENTS)
    + """SELECT 'orders' AS repo_id, commit_sha, count(*) AS parents FROM parents
         GROUP BY commit_sha HAVING count(*) > 1""",
)
def merge_commits(spark, sf):
    return h.merges(a.commit_parents(spark, sf))


@query(
    "topo_order",
    ctes(v.COMMITS)
    + "SELECT sha, row_number() OVER (ORDER BY committed_epoch, sha) AS seq FROM commits",
)
def topo_order(spark, sf):
    commits = a.commits(spark, sf)
    keys = lc.walk_keys(commits, a.commit_parents(spark, sf))
    return ordered(keys, [lc.REPO, "walk_key"]).frame.select("sha", SEQ)


# Every list of waited-for ancestors along every path, cut at each step to what is younger than the commit.
SKEWED = """
clock AS (SELECT sha, lpad(CAST(committed_epoch + CASE WHEN CAST(sha AS BIGINT) % 11 = 0 THEN 34560000 ELSE 0 END AS VARCHAR), 12, '0')
            || '/' || sha AS k FROM commits),
links AS (SELECT DISTINCT parent_sha, commit_sha FROM parents),
walk AS (
  SELECT sha, [k] AS path FROM clock WHERE sha NOT IN (SELECT commit_sha FROM links)
  UNION
  SELECT c.sha, list_append(list_filter(w.path, lambda x: x > c.k), c.k) FROM walk w
  JOIN links l ON l.parent_sha = w.sha JOIN clock c ON c.sha = l.commit_sha),
keyed AS (SELECT sha, max(path) AS path FROM walk GROUP BY sha)
"""


@query(
    "topo_order_skewed",
    ctes(v.COMMITS, v.PARENTS, SKEWED, recursive=True)
    + "SELECT sha, row_number() OVER (ORDER BY path) AS seq, len(path) AS waits FROM keyed",
)
def topo_order_skewed(spark, sf):
    """The clock of every eleventh commit runs four hundred days ahead."""
    ahead = F.when(F.col("sha").cast("long") % 11 == 0, 400 * 86400).otherwise(0)
    commits = a.commits(spark, sf).withColumn("committed_epoch", F.col("committed_epoch") + ahead)
    keys = lc.walk_keys(commits, a.commit_parents(spark, sf))
    found = ordered(keys, [lc.REPO, "walk_key"]).frame
    return found.select("sha", SEQ, F.size("walk_key").cast("long").alias("waits"))


@query(
    "commit_prefix_lookup",
    ctes(v.COMMITS)
    + """SELECT prefix, count(sha) AS candidates,
           CASE count(sha) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS answer,
           CASE WHEN count(sha) = 1 THEN min(sha) END AS sha
         FROM (SELECT DISTINCT substring(lpad(CAST(l_orderkey * 7 AS VARCHAR), 19, '0'), 1,
                      CAST(16 + l_orderkey % 3 AS INTEGER)) AS prefix FROM lineitem) p
         LEFT JOIN (SELECT sha, substring(sha, 1, n) AS start FROM commits, (VALUES (16), (17), (18)) lengths(n)) c
           ON start = prefix GROUP BY prefix""",
)
def commit_prefix_lookup(spark, sf):
    lines = a.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 7).alias("k"))
    length = (16 + F.floor(F.col("k") / 7) % 3).cast("int")
    refs = lines.select(F.lit("orders").alias(lc.REPO), F.substring(a.key_text("k"), F.lit(1), length).alias("ref"))
    return h.prefix_answer(m.resolve_prefixes(refs, a.commits(spark, sf)))


@query(
    "change_words",
    ctes(v.RENAMES)
    + """SELECT commit_sha, coalesce(old_path || ' → ' || path, path) AS shown_path,
           CASE change_type WHEN 'A' THEN 'added' WHEN 'D' THEN 'deleted' WHEN 'M' THEN 'modified'
                            WHEN 'R' THEN 'renamed' END AS change,
           CASE WHEN added_lines IS NULL AND deleted_lines IS NULL THEN '-'
                ELSE printf('+%d/-%d', added_lines, deleted_lines) END AS lines
         FROM renames""",
)
def change_words(spark, sf):
    return a.rename_log(spark, sf).select(
        "commit_sha",
        h.shown_path().alias("shown_path"),
        h.change_word(F.col("change_type")).alias("change"),
        h.line_counters().alias("lines"),
    )


NAME = "u7"


@query(
    "commits_touching_name",
    ctes(v.RENAMES)
    + f"SELECT repo_id, commit_sha FROM renames WHERE path = '{NAME}' OR old_path = '{NAME}'",
)
def commits_touching_name(spark, sf):
    return h.commits_touching(a.rename_log(spark, sf), NAME)


IDENTITY = f"""
carried AS (SELECT DISTINCT life_id FROM ev WHERE path = '{NAME}'),
by_identity AS (SELECT DISTINCT repo_id, commit_sha FROM ev WHERE life_id IN (SELECT life_id FROM carried)),
by_name AS (SELECT DISTINCT repo_id, commit_sha FROM ev WHERE path = '{NAME}' OR old_path = '{NAME}')"""


def _rename_lives(spark, sf):
    return lc.lifecycle_events(a.rename_sequence(spark, sf))


@query("commits_of_identity", ctes(v.RENAME_LIVES, IDENTITY, recursive=True) + "SELECT * FROM by_identity")
def commits_of_identity(spark, sf):
    return h.commits_of(_rename_lives(spark, sf).frame, NAME)


@query(
    "name_vs_identity_diff",
    ctes(v.RENAME_LIVES, IDENTITY, recursive=True)
    + """SELECT coalesce(n.repo_id, i.repo_id) AS repo_id, coalesce(n.commit_sha, i.commit_sha) AS commit_sha,
           n.commit_sha IS NOT NULL AS by_name, i.commit_sha IS NOT NULL AS by_identity
         FROM by_name n FULL JOIN by_identity i ON i.commit_sha = n.commit_sha""",
)
def name_vs_identity_diff(spark, sf):
    return h.name_against_identity(_rename_lives(spark, sf).frame, NAME)


# ------------------------------------------------------------------ identities

EVENT_COLUMNS = ["life_id", SEQ, "commit_sha", "change_type", "path", "old_path", "added_lines", "deleted_lines", "similarity"]


@query("lifecycle_events", ctes(v.RENAME_LIVES, recursive=True) + f"SELECT {', '.join(EVENT_COLUMNS)} FROM ev")
def lifecycle_events(spark, sf):
    return _rename_lives(spark, sf).frame.select(*EVENT_COLUMNS)


@query("lifecycle_path_history", ctes(v.RENAME_LIVES, v.NAMES, recursive=True) + "SELECT life_id, seq, path FROM names")
def lifecycle_path_history(spark, sf):
    return lc.path_history(_rename_lives(spark, sf)).select("life_id", SEQ, "path")


@query(
    "lifecycle_alive",
    ctes(v.RENAME_LIVES, v.STATISTICS, recursive=True)
    + "SELECT is_deleted, count(*) AS lives, CAST(sum(renames) AS BIGINT) AS renames FROM statistics GROUP BY is_deleted",
)
def lifecycle_alive(spark, sf):
    stats = lc.file_statistics(_rename_lives(spark, sf).frame)
    return stats.groupBy("is_deleted").agg(
        F.count(F.lit(1)).alias("lives"), F.sum("renames").alias("renames")
    )


STAT_COLUMNS = [
    "life_id", "current_path", "created_epoch", "created_sha", "last_modified_epoch", "last_modified_sha",
    "commits", "modifications", "renames", "additions", "deletions", "net_change", "churn",
    "binary_changes", "is_deleted", "deleted_sha", "deleted_epoch",
]
STATS = f"SELECT {', '.join(STAT_COLUMNS)} FROM statistics\n"


@query("file_stats", ctes(v.RENAME_LIVES, v.STATISTICS, recursive=True) + STATS)
def file_stats(spark, sf):
    return lc.file_statistics(_rename_lives(spark, sf).frame).select(*STAT_COLUMNS)


def _order_lives(spark, sf):
    return lc.lifecycle_events(a.order_sequence(spark, sf), renames=False)


@query("file_stats_no_renames", ctes(v.FILE_LIVES, v.STATISTICS) + STATS)
def file_stats_no_renames(spark, sf):
    return lc.file_statistics(_order_lives(spark, sf).frame).select(*STAT_COLUMNS)


RANKED = "ORDER BY commits DESC, current_path, life_id LIMIT 20"
HOT_COLUMNS = ["life_id", "current_path", "commits", "additions", "deletions", "churn"]


@query(
    "hotspots",
    ctes(v.RENAME_LIVES, v.STATISTICS, recursive=True)
    + f"SELECT {', '.join(HOT_COLUMNS)} FROM statistics WHERE NOT is_deleted {RANKED}",
)
def hotspots(spark, sf):
    return lc.hotspots(lc.file_statistics(_rename_lives(spark, sf).frame)).select(*HOT_COLUMNS)


@query(
    "hotspots_incl_deleted",
    ctes(v.FILE_LIVES, v.STATISTICS) + f"SELECT {', '.join(HOT_COLUMNS)} FROM statistics {RANKED}",
)
def hotspots_incl_deleted(spark, sf):
    stats = lc.file_statistics(_order_lives(spark, sf).frame)
    return lc.hotspots(stats, include_deleted=True).select(*HOT_COLUMNS)


@query(
    "inventory",
    ctes(v.FILE_LIVES, v.STATISTICS)
    + f"""SELECT {', '.join(HOT_COLUMNS)}, CASE WHEN is_deleted THEN 'deleted' ELSE 'alive' END AS state
          FROM statistics""",
)
def inventory(spark, sf):
    return lc.inventory(lc.file_statistics(_order_lives(spark, sf).frame)).select(*HOT_COLUMNS, "state")


@query(
    "find_file_lives",
    ctes(v.RENAME_LIVES, v.STATISTICS, IDENTITY, recursive=True)
    + STATS
    + "WHERE life_id IN (SELECT life_id FROM carried)",
)
def find_file_lives(spark, sf):
    events = _rename_lives(spark, sf).frame
    mine = events.join(lc.lives_of_path(events, NAME), [lc.REPO, "life_id"], "left_semi")
    return lc.file_statistics(mine).select(*STAT_COLUMNS)


# ------------------------------------------------------------------ co-change

SIZES = """
sizes AS (SELECT commit_sha, count(DISTINCT life_id) AS identities FROM ev GROUP BY commit_sha)"""


@query("commit_size", ctes(v.FILE_LIVES, SIZES) + "SELECT commit_sha, identities FROM sizes")
def commit_size(spark, sf):
    return cc.commit_sizes(_order_lives(spark, sf).frame).select("commit_sha", "identities")


def _pairs_sql(which: str, limit: int) -> str:
    return f"""
asked AS ({which}),
own AS (SELECT DISTINCT life_id, commit_sha, identities FROM ev JOIN sizes USING (commit_sha)
        WHERE life_id IN (SELECT life_id FROM asked)),
shared AS (SELECT o.life_id AS asked_life, e.life_id AS partner_life, count(DISTINCT e.commit_sha) AS shared_commits
           FROM own o JOIN ev e ON e.commit_sha = o.commit_sha AND e.life_id <> o.life_id
           WHERE o.identities <= {limit} GROUP BY ALL),
sample AS (SELECT life_id AS asked_life, count(*) FILTER (WHERE identities <= {limit}) AS analyzed_commits,
                  count(*) FILTER (WHERE identities > {limit}) AS large_commits_excluded
           FROM own GROUP BY life_id)"""


BUSIEST = "SELECT life_id FROM statistics ORDER BY commits DESC, current_path, life_id LIMIT 1"
PARTNERS = """
SELECT asked_life, partner_life, st.current_path AS path, shared_commits, analyzed_commits,
       round(shared_commits / analyzed_commits, 6) AS score
FROM shared JOIN sample USING (asked_life) JOIN statistics st ON st.life_id = partner_life
"""


def _shown(partners):
    return partners.select(
        "asked_life", "partner_life", "path", "shared_commits", "analyzed_commits",
        F.round("score", 6).alias("score"),
    )


@query(
    "cochange_busiest",
    ctes(v.FILE_LIVES, v.STATISTICS, SIZES, _pairs_sql(BUSIEST, 100)) + PARTNERS + "WHERE shared_commits >= 2",
)
def cochange_busiest(spark, sf):
    events = _order_lives(spark, sf).stored("lives").frame
    stats = materialise(lc.file_statistics(events), "statistics")
    busiest = lc.hotspots(stats, include_deleted=True, limit=1)
    _, partners = cc.cochange(events, busiest, stats)
    return _shown(cc.strongest_first(partners))


ONE = "s7"
CARRIES = f"SELECT DISTINCT life_id FROM ev WHERE path = '{ONE}'"


@query(
    "cochange_one",
    ctes(v.FILE_LIVES, v.STATISTICS, SIZES, _pairs_sql(CARRIES, 8)) + PARTNERS + "WHERE shared_commits >= 3",
)
def cochange_one(spark, sf):
    events = _order_lives(spark, sf).stored("lives").frame
    stats = materialise(lc.file_statistics(events), "statistics")
    _, partners = cc.cochange(
        events, lc.lives_of_path(events, ONE), stats, large_commit_limit=a.LARGE_COMMIT, min_shared=3
    )
    return _shown(cc.strongest_first(partners))


@query(
    "cochange_reports",
    ctes(v.FILE_LIVES, SIZES, _pairs_sql(CARRIES, 8))
    + """SELECT asked_life, analyzed_commits, large_commits_excluded,
           coalesce((SELECT count(*) FROM shared s WHERE s.asked_life = sample.asked_life
                     AND shared_commits < 3), 0) AS hidden_pairs FROM sample""",
)
def cochange_reports(spark, sf):
    events = _order_lives(spark, sf).stored("lives").frame
    stats = materialise(lc.file_statistics(events), "statistics")
    reports, _ = cc.cochange(
        events, lc.lives_of_path(events, ONE), stats, large_commit_limit=a.LARGE_COMMIT, min_shared=3
    )
    return reports.select("asked_life", "analyzed_commits", "large_commits_excluded", "hidden_pairs")


# ------------------------------------------------------------------ definitions


def _definitions(spark, sf):
    return st.definition_history(
        a.version_sequence(spark, sf),
        a.file_versions(spark, sf),
        a.definition_rows(spark, sf),
        a.DEFINITION_ORDER,
    )


STEP_COLUMNS = ["life_id", SEQ, "commit_sha", "state", "step", "previous_commit_sha"]
DEF_COLUMNS = [
    "life_id", "step", "kind", "qualname", "occurrence", "change", "commit_sha",
    "previous_commit_sha", "lineno", "end_lineno", "blind_spots",
]


@query("version_steps", ctes(v.STEPS) + f"SELECT {', '.join(STEP_COLUMNS)} FROM steps")
def version_steps(spark, sf):
    steps = st.version_steps(a.version_sequence(spark, sf), a.file_versions(spark, sf))
    return steps.select(*STEP_COLUMNS)


@query(
    "definition_occurrence",
    ctes(v.DEFINITIONS)
    + "SELECT commit_sha, kind, qualname, occurrence, lineno, fingerprint FROM occ",
)
def definition_occurrence(spark, sf):
    return st.occurrences(a.definition_rows(spark, sf), a.DEFINITION_ORDER).select(
        "commit_sha", "kind", "qualname", "occurrence", "lineno", "fingerprint"
    )


@query("definition_changes", ctes(v.DEFINITION_EVENTS) + f"SELECT {', '.join(DEF_COLUMNS)} FROM devents")
def definition_changes(spark, sf):
    return _definitions(spark, sf).events.select(*DEF_COLUMNS)


@query(
    "definition_deletions",
    ctes(v.DEFINITION_EVENTS)
    + """SELECT d.life_id, d.kind, d.qualname, d.occurrence, d.commit_sha, c.state = 'file_end' AS with_the_file
         FROM devents d JOIN compared c ON c.life_id = d.life_id AND c.step = d.step WHERE d.change = 'deleted'""",
)
def definition_deletions(spark, sf):
    found = _definitions(spark, sf)
    state = found.steps.where("state in ('read', 'file_end')").select(lc.REPO, "life_id", "step", "state")
    return (
        found.events.where("change = 'deleted'")
        .join(state, [lc.REPO, "life_id", "step"])
        .select(
            "life_id", "kind", "qualname", "occurrence", "commit_sha",
            (F.col("state") == "file_end").alias("with_the_file"),
        )
    )


@query("definition_gaps", ctes(v.STEPS) + "SELECT life_id, step, seq, commit_sha, path, state FROM gaps")
def definition_gaps(spark, sf):
    return _definitions(spark, sf).gaps.select("life_id", "step", SEQ, "commit_sha", "path", "state")


@query(
    "definition_lives",
    ctes(v.DEFINITION_EVENTS)
    + """SELECT life_id, kind, qualname, occurrence, events, first_step, last_change, last_commit_sha
         FROM dlives""",
)
def definition_lives(spark, sf):
    return _definitions(spark, sf).lives.select(
        "life_id", "kind", "qualname", "occurrence", "events", "first_step", "last_change", "last_commit_sha"
    )


@query(
    "definition_unresolved",
    ctes(v.DEFINITION_EVENTS)
    + """SELECT d.life_id, kind, qualname, occurrence, t.blind_spots AS unresolved
         FROM dlives d JOIN tails t ON t.life_id = d.life_id WHERE last_change <> 'deleted'""",
)
def definition_unresolved(spark, sf):
    return (
        _definitions(spark, sf)
        .lives.where("unresolved > 0")
        .select("life_id", "kind", "qualname", "occurrence", "unresolved")
    )


@query(
    "definition_kind_counts",
    ctes(v.DEFINITIONS)
    + """SELECT d.commit_sha, count(*) AS definitions, count(*) FILTER (WHERE d.kind = 'class') AS classes,
           count(*) FILTER (WHERE d.kind = 'function') AS functions,
           count(*) FILTER (WHERE d.kind = 'async function') AS async_functions,
           count(*) FILTER (WHERE d.kind <> 'class' AND EXISTS (
             SELECT 1 FROM defs c WHERE c.commit_sha = d.commit_sha AND c.kind = 'class' AND c.qualname =
               CASE WHEN contains(d.qualname, '.<locals>.') THEN split_part(d.qualname, '.<locals>.', 1)
                    ELSE split_part(d.qualname, '.', 1) END)) AS methods
         FROM defs d GROUP BY d.commit_sha""",
)
def definition_kind_counts(spark, sf):
    return st.kind_counts(a.definition_rows(spark, sf)).select(
        "commit_sha", "definitions", "classes", "functions", "async_functions", "methods"
    )


@query(
    "version_select",
    ctes(v.STEPS)
    + """SELECT life_id, arg_max(commit_sha, seq) AS commit_sha, arg_max(state, seq) AS state,
           last(previous_commit_sha ORDER BY seq) AS compared_with FROM steps GROUP BY life_id""",
)
def version_select(spark, sf):
    steps = st.version_steps(a.version_sequence(spark, sf), a.file_versions(spark, sf))
    return st.newest_versions(steps).select(
        "life_id", "commit_sha", "state", F.col("previous_commit_sha").alias("compared_with")
    )
