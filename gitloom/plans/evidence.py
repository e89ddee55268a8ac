"""Registered queries over units of history and their bounded views."""

from __future__ import annotations

from pyspark.sql import functions as F

from gitloom.operators import evidence as ev
from gitloom.operators import history as h
from gitloom.operators import lifecycle as lc
from gitloom.operators import structure as st
from gitloom.operators.lifecycle import REPO
from gitloom.plans import sqlviews as v
from gitloom.plans.registry import ctes, query
from gitloom.session import materialise
from gitloom.sources import adapters as a

MEMBERS = """
members AS (SELECT substring(committed_at, 1, 4) AS unit, sha AS commit_sha,
                   row_number() OVER (ORDER BY committed_epoch, sha) AS ordinal FROM commits)"""
CHANGES = """
touches AS (SELECT f.*, m.unit, m.ordinal FROM files f JOIN members m USING (commit_sha)),
changes AS (
  SELECT unit, path, count(*) AS touches, CAST(sum(coalesce(added_lines, 0)) AS BIGINT) AS added_lines,
         CAST(sum(coalesce(deleted_lines, 0)) AS BIGINT) AS deleted_lines,
         bool_or(added_lines IS NULL AND deleted_lines IS NULL) AS is_binary,
         arg_min(change_type, ordinal) AS first_change, arg_max(change_type, ordinal) AS last_change
  FROM touches GROUP BY unit, path)"""
NET = """
net AS (
  SELECT *, CASE WHEN touches % 5 <> 0 THEN CASE WHEN first_change = 'A' THEN 'A' ELSE 'M' END END
              AS net_status,
         CASE WHEN touches % 5 <> 0 THEN 'b' || CAST(touches % 3 AS VARCHAR) END AS new_blob,
         added_lines % 2 = 0 AS has_text
  FROM changes)"""


@query(
    "change_states",
    ctes(v.COMMITS, v.PARENTS, v.FILES, v.RANGES)
    + """, merges AS (SELECT commit_sha FROM parents GROUP BY 1 HAVING count(*) > 1),
         seen AS (SELECT commit_sha, path, count(*) AS n FROM ranges GROUP BY ALL)
         SELECT f.commit_sha, f.path, CASE WHEN m.commit_sha IS NOT NULL THEN 'no_diff_recorded'
             WHEN change_type = 'D' THEN 'deleted_file' WHEN added_lines IS NULL THEN 'binary'
             WHEN n IS NOT NULL THEN 'ranges' ELSE 'no_ranges_recorded' END AS diff_state,
           CASE WHEN m.commit_sha IS NULL AND change_type <> 'D' AND added_lines IS NOT NULL
                THEN coalesce(n, 0) ELSE 0 END AS ranges
         FROM files f LEFT JOIN merges m ON m.commit_sha = f.commit_sha
         LEFT JOIN seen s ON s.commit_sha = f.commit_sha AND s.path = f.path""",
)
def change_states(spark, sf):
    return ev.change_states(
        a.commit_files(spark, sf),
        h.merges(a.commit_parents(spark, sf)),
        a.patch_ranges(spark, sf),
    ).select("commit_sha", "path", "diff_state", "ranges")


@query(
    "range_header",
    ctes(v.COMMITS, v.PARENTS, MEMBERS)
    + """SELECT unit, count(*) AS commits, count(*) FILTER (WHERE sha IN (
             SELECT commit_sha FROM parents GROUP BY 1 HAVING count(*) > 1)) AS merges,
           array_to_string(list_sort(list(DISTINCT author_name || ' <' || author_email || '>')), ', ') AS authors,
           arg_min(authored_at, ordinal) AS first_authored_at, arg_max(authored_at, ordinal) AS last_authored_at
         FROM members JOIN commits ON sha = commit_sha GROUP BY unit""",
)
def range_header(spark, sf):
    merges = h.merges(a.commit_parents(spark, sf))
    found = ev.header(a.yearly_members(spark, sf), a.commits(spark, sf), merges).drop(REPO)
    return found.withColumn("authors", F.array_join("authors", ", "))


def _touches(spark, sf, members=None):
    members = a.yearly_members(spark, sf) if members is None else members
    return ev.occurrences(members, a.commit_files(spark, sf))


@query(
    "range_occurrences",
    ctes(v.COMMITS, v.FILES, MEMBERS, CHANGES)
    + "SELECT unit, path, ordinal, commit_sha, change_type, added_lines, deleted_lines FROM touches",
)
def range_occurrences(spark, sf):
    return _touches(spark, sf).select(
        "unit", "path", "ordinal", "commit_sha", "change_type", "added_lines", "deleted_lines"
    )


def _changes(spark, sf, members=None):
    changes = materialise(ev.path_changes(_touches(spark, sf, members)), "changes")
    return ev.with_net(changes, a.net_changes(changes), a.net_texts(changes))


@query(
    "range_changes",
    ctes(v.COMMITS, v.FILES, MEMBERS, CHANGES, NET)
    + """SELECT unit, path, touches, added_lines, deleted_lines, net_status,
           is_binary OR (net_status IS NOT NULL AND new_blob <> 'b0' AND NOT has_text) AS is_binary
         FROM net""",
)
def range_changes(spark, sf):
    return _changes(spark, sf).select(
        "unit", "path", "touches", "added_lines", "deleted_lines", "net_status", "is_binary"
    )


KIND = """
partition_ AS (
  SELECT unit, path, CASE
      WHEN net_status IS NULL AND first_change IN ('A', 'R', 'C') AND last_change = 'D' THEN 'gone_within_range'
      WHEN net_status IS NULL OR new_blob = 'b0' THEN 'net_unchanged'
      WHEN NOT has_text THEN 'binary_no_text' END AS kind FROM net),
absent AS (
  SELECT unit, kind, path, CASE kind
      WHEN 'gone_within_range' THEN 'created inside the range and deleted before the tip'
      WHEN 'net_unchanged' THEN 'touched inside the range, and the endpoints hold one content'
      ELSE 'the endpoint blobs are binary, so git prints no diff text' END AS detail
  FROM partition_ WHERE kind IS NOT NULL
  UNION ALL
  SELECT unit, CASE WHEN status = 'F' AND message = '2-HIGH' THEN 'not_analyzed' ELSE 'merge_no_diff' END,
         NULL, CASE WHEN status = 'F' AND message = '2-HIGH' THEN 'the analysis holds no row for '
                    ELSE 'git prints no diff for the merge ' END || m.commit_sha FROM members m JOIN commits ON sha = m.commit_sha
  WHERE (status = 'F' AND message = '2-HIGH') OR sha IN (SELECT commit_sha FROM merges)
  UNION ALL
  SELECT unit, CASE state WHEN 'not_stored' THEN 'no_version_stored' WHEN 'parse_failed' THEN state
                          ELSE 'not_in_this_commit' END, path,
         CASE state WHEN 'parse_failed' THEN 'SyntaxError: invalid syntax'
                    WHEN 'not_stored' THEN 'no version was stored for this commit'
                    ELSE 'the file was not in this commit' END
  FROM steps JOIN members USING (commit_sha) WHERE state <> 'read')"""
ABSENT = ctes(
    v.COMMITS, v.PARENTS, "merges AS (SELECT commit_sha FROM parents GROUP BY 1 HAVING count(*) > 1)",
    v.FILES, MEMBERS, CHANGES, NET, v.STEPS, KIND,
)


def _absences(spark, sf):
    """High-priority F orders are taken as commits the store does not hold."""
    stored = a.commits(spark, sf).where("not (status = 'F' and message = '2-HIGH')")
    walk = a.order_walk(spark, sf)
    members = a.yearly_members(spark, sf, walk)
    return ev.range_absences(
        members,
        stored,
        h.merges(a.commit_parents(spark, sf, walk=walk)),
        st.version_steps(a.version_sequence(spark, sf, walk), a.file_versions(spark, sf)),
        _changes(spark, sf, members),
    )


@query("absences", ABSENT + "SELECT unit, kind, path, detail FROM absent")
def absences(spark, sf):
    return _absences(spark, sf).select("unit", "kind", "path", "detail")


@query(
    "range_net_partition",
    ABSENT + "SELECT unit, kind, count(*) AS rows FROM absent GROUP BY unit, kind",
)
def range_net_partition(spark, sf):
    return _absences(spark, sf).groupBy("unit", "kind").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "commit_absences",
    ctes(v.COMMITS, v.PARENTS, v.FILES, v.STEPS)
    + """SELECT commit_sha AS unit, 'merge_no_diff' AS kind, NULL AS path FROM parents
         GROUP BY 1 HAVING count(*) > 1
         UNION ALL SELECT commit_sha, 'binary_no_text', path FROM files WHERE added_lines IS NULL
         UNION ALL SELECT commit_sha, CASE state WHEN 'not_stored' THEN 'no_version_stored'
             WHEN 'parse_failed' THEN state ELSE 'not_in_this_commit' END, path
         FROM steps WHERE state <> 'read'""",
)
def commit_absences(spark, sf):
    """Every commit is a unit of its own."""
    members = a.commits(spark, sf).select(
        REPO, F.col("sha").alias("unit"), F.col("sha").alias("commit_sha"), F.lit(1).alias("ordinal")
    )
    steps = st.version_steps(a.version_sequence(spark, sf), a.file_versions(spark, sf))
    merges = h.merges(a.commit_parents(spark, sf))
    return ev.commit_absences(members, merges, a.commit_files(spark, sf), steps).select("unit", "kind", "path")


# ------------------------------------------------------------------ lives seen from a range

TOTALS = f"""
totals AS (SELECT *, row_number() OVER (PARTITION BY life_id ORDER BY seq) AS commits FROM ev),
lastin AS (
  SELECT m.unit, t.life_id, max(t.seq) AS last_seq, min(t.commits) AS first_position
  FROM totals t JOIN members m ON m.commit_sha = t.commit_sha GROUP BY m.unit, t.life_id),
left_ AS (
  SELECT l.unit, l.life_id, arg_max(path, seq) AS path, count(*) AS commits,
         count(*) FILTER (WHERE {v.EDIT}) AS modifications,
         CAST(sum(coalesce(added_lines, 0)) AS BIGINT) AS additions,
         CAST(sum(coalesce(deleted_lines, 0)) AS BIGINT) AS deletions,
         arg_max(commit_sha, seq) FILTER (WHERE {v.EDIT}) AS last_modified_sha,
         arg_max(change_type, seq) = 'D' AS is_deleted, min(first_position) AS first_position
  FROM lastin l JOIN totals t ON t.life_id = l.life_id AND t.seq <= l.last_seq
  GROUP BY l.unit, l.life_id)"""
SEEN = ctes(v.COMMITS, v.FILE_LIVES, MEMBERS, TOTALS)


def _totals(spark, sf):
    return ev.running_statistics(lc.lifecycle_events(a.order_sequence(spark, sf), renames=False))


LEFT = ["unit", "life_id", "path", "commits", "modifications", "additions", "deletions", "last_modified_sha", "is_deleted"]


@query("range_lives", SEEN + f"SELECT {', '.join(LEFT)} FROM left_")
def range_lives(spark, sf):
    return ev.lives_as_left(_totals(spark, sf), a.yearly_members(spark, sf)).select(*LEFT)


NUMBERS = """
numbers AS (SELECT *, row_number() OVER (PARTITION BY life_id ORDER BY seq) AS commits FROM ev),
touched AS (
  SELECT m.unit, n.life_id, arg_max(path, seq) AS path, min(n.commits) AS first_position
  FROM numbers n JOIN members m ON m.commit_sha = n.commit_sha GROUP BY m.unit, n.life_id),
wanted AS (
  SELECT unit, life_id, first_position - 1 AS total,
         unnest(range(greatest(first_position - 5, 1), first_position)) AS position FROM touched),
earlier AS (
  SELECT w.unit, w.life_id, w.position, w.total, n.commit_sha, n.change_type, n.added_lines, n.deleted_lines
  FROM wanted w JOIN numbers n ON n.life_id = w.life_id AND n.commits = w.position)"""


@query(
    "earlier_commits_window",
    ctes(v.COMMITS, v.FILE_LIVES, MEMBERS, NUMBERS)
    + """SELECT unit, life_id, position, total, commit_sha, change_type, added_lines, deleted_lines FROM earlier""",
)
def earlier_commits_window(spark, sf):
    numbers = ev.event_numbers(lc.lifecycle_events(a.order_sequence(spark, sf), renames=False))
    touched = ev.touched_lives(numbers, a.yearly_members(spark, sf))
    return ev.earlier_commits(numbers, touched).select(
        "unit", "life_id", "position", "total", "commit_sha", "change_type", "added_lines", "deleted_lines"
    )


@query(
    "bounds",
    SEEN
    + """, whole AS (SELECT life_id, count(*) AS n FROM ev GROUP BY 1)
         SELECT unit, greatest(count(*) FILTER (WHERE n >= 2) - 5, 0) AS co_change_files_omitted,
           CAST(sum(greatest(first_position - 1 - 5, 0)) AS BIGINT) AS history_commits_omitted
         FROM left_ JOIN whole USING (life_id) GROUP BY unit""",
)
def bounds(spark, sf):
    totals = _totals(spark, sf)
    left = ev.lives_as_left(totals, a.yearly_members(spark, sf))
    return ev.bounds(left, lc.file_statistics(totals.select(*a.FILE_EVENT))).drop(REPO)


# ------------------------------------------------------------------ definitions in a range

PRESENCE = ctes(v.COMMITS, v.DEFINITION_EVENTS, MEMBERS) + """,
tip AS (SELECT unit, path, arg_max(state, ordinal) AS tip FROM steps JOIN members USING (commit_sha)
        WHERE state IN ('read', 'parse_failed') GROUP BY ALL),
presence AS (
  SELECT m.unit, d.path, d.qualname, d.occurrence, min(kind) AS kind, count(*) AS events,
    CAST(coalesce(arg_max(greatest(end_lineno - lineno + 1, 0), ordinal) FILTER (WHERE lineno IS NOT NULL), 0)
      AS BIGINT) AS size,
    CASE WHEN arg_min(change, (ordinal, kind)) = 'created' THEN 'absent' ELSE 'present' END AS presence_base,
    CASE WHEN any_value(t.tip) = 'parse_failed' THEN 'unreadable'
         WHEN arg_max(change, (ordinal, kind)) = 'deleted' THEN 'absent' ELSE 'present' END AS presence_tip
  FROM devents d JOIN members m USING (commit_sha)
  LEFT JOIN tip t ON t.unit = m.unit AND t.path = d.path
  GROUP BY m.unit, d.path, d.qualname, d.occurrence)
"""
PRESENT = ["unit", "path", "qualname", "occurrence", "kind", "events", "size", "presence_base", "presence_tip"]


def _presence(spark, sf):
    walk = a.order_walk(spark, sf)
    found = st.definition_history(
        a.version_sequence(spark, sf, walk), a.file_versions(spark, sf), a.definition_rows(spark, sf), a.DEFINITION_ORDER,
    )
    return ev.definition_presence(found.events, a.yearly_members(spark, sf, walk), found.steps)


@query("range_presence", PRESENCE + f"SELECT {', '.join(PRESENT)} FROM presence")
def range_presence(spark, sf):
    return _presence(spark, sf).select(*PRESENT)


# ------------------------------------------------------------------ bounded views


@query(
    "selection_definitions",
    PRESENCE
    + """SELECT unit, path, qualname, occurrence, size FROM (SELECT *, row_number() OVER (
           PARTITION BY unit ORDER BY size DESC, path, qualname, occurrence) AS r FROM presence) WHERE r <= 20""",
)
def selection_definitions(spark, sf):
    return ev.kept_definitions(_presence(spark, sf)).select("unit", "path", "qualname", "occurrence", "size")


@query(
    "selection_files",
    ctes(v.COMMITS, v.FILES, MEMBERS, CHANGES)
    + """SELECT unit, path, added_lines, deleted_lines FROM (SELECT *, row_number() OVER (
           PARTITION BY unit ORDER BY added_lines + deleted_lines DESC, path) AS r FROM changes) WHERE r <= 20""",
)
def selection_files(spark, sf):
    changes = ev.path_changes(_touches(spark, sf))
    return ev.kept_changes(changes).select("unit", "path", "added_lines", "deleted_lines")


MOVED = """,
moved AS (SELECT m.unit, m.commit_sha, m.ordinal,
            CAST(coalesce(sum(coalesce(added_lines, 0) + coalesce(deleted_lines, 0)), 0) AS BIGINT) AS moved
          FROM members m LEFT JOIN files f ON f.commit_sha = m.commit_sha GROUP BY ALL)
"""


@query(
    "selection_commits",
    ctes(v.COMMITS, v.FILES, MEMBERS)
    + MOVED
    + """SELECT unit, commit_sha, ordinal, moved FROM (SELECT *, row_number() OVER (
           PARTITION BY unit ORDER BY moved DESC, commit_sha) AS r FROM moved) WHERE r <= 25""",
)
def selection_commits(spark, sf):
    members = a.yearly_members(spark, sf)
    touches = ev.occurrences(members, a.commit_files(spark, sf))
    return ev.kept_commits(members, touches).select("unit", "commit_sha", "ordinal", "moved")


@query(
    "selection_absences",
    ABSENT
    + """SELECT unit, kind, path, detail FROM (SELECT *, row_number() OVER (
           PARTITION BY unit ORDER BY coalesce(path, ''), kind, detail) AS r FROM absent) WHERE r <= 20""",
)
def selection_absences(spark, sf):
    return ev.kept_absences(_absences(spark, sf)).select("unit", "kind", "path", "detail")


@query(
    "selection_lives",
    SEEN
    + """, changes AS (SELECT unit, path, sum(coalesce(added_lines, 0)) + sum(coalesce(deleted_lines, 0)) AS n
                  FROM files JOIN members USING (commit_sha) GROUP BY ALL),
         kept AS (SELECT unit, path FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY n DESC, path) AS r
                  FROM changes) WHERE r <= 20),
         reached AS (SELECT DISTINCT l.unit, l.life_id FROM left_ l JOIN ev e ON e.life_id = l.life_id
                     JOIN kept k ON k.unit = l.unit AND k.path = e.path)
         SELECT unit, life_id, path FROM (SELECT l.*, row_number() OVER (PARTITION BY unit ORDER BY life_id) AS r
           FROM left_ l JOIN reached USING (unit, life_id)) WHERE r <= 20""",
)
def selection_lives(spark, sf):
    members = a.yearly_members(spark, sf)
    lives = lc.lifecycle_events(a.order_sequence(spark, sf), renames=False)
    totals = ev.running_statistics(lives)
    changes = ev.kept_changes(ev.path_changes(ev.occurrences(members, a.commit_files(spark, sf))))
    names = totals.select(REPO, "life_id", "path").distinct()
    return ev.kept_lives(ev.lives_as_left(totals, members), names, changes).select("unit", "life_id", "path")


@query(
    "message_cut",
    """SELECT doc_id, substring(text, 1, 4000) AS message,
         CAST(greatest(length(text) - 4000, 0) AS INTEGER) AS characters_omitted FROM documents""",
)
def message_cut(spark, sf):
    texts = a.table(spark, sf, "documents").select("doc_id", F.col("text").alias("message"))
    return ev.cut_messages(texts)
