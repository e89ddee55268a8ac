"""Registered queries over statements, their evidence, and moving them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gitloom.operators import interchange as ix
from gitloom.operators import lifecycle as lc
from gitloom.operators import memory as m
from gitloom.operators.lifecycle import REPO
from gitloom.plans import sqlviews as v
from gitloom.plans.registry import ctes, query
from gitloom.session import materialise
from gitloom.sources import adapters as a


@query(
    "memory_state_fold",
    """WITH acts AS (
         SELECT CAST(user_id AS VARCHAR) || '-' || json_extract_string(props, '$.k') AS memory_id, event_id,
                CASE event_type WHEN 'purchase' THEN 'supersede' WHEN 'error' THEN 'invalidate'
                                ELSE 'admit' END AS act, CAST(floor(epoch(ts)) AS BIGINT) AS at
         FROM events),
       ins AS (SELECT memory_id, min(event_id) AS first_in FROM acts WHERE act = 'admit' GROUP BY 1),
       outs AS (SELECT a.memory_id, min(event_id) AS first_out FROM acts a JOIN ins USING (memory_id)
                WHERE act <> 'admit' AND event_id > first_in GROUP BY 1),
       n AS (SELECT memory_id, count(*) AS acts FROM acts GROUP BY 1)
       SELECT i.memory_id, x.at AS admitted_epoch,
              CASE y.act WHEN 'supersede' THEN 'superseded' WHEN 'invalidate' THEN 'invalidated'
                         ELSE 'active' END AS state,
              y.at AS ended_epoch,
              CASE WHEN y.act = 'invalidate' THEN CAST(first_out AS VARCHAR) END AS end_reason,
              CASE WHEN y.act = 'supersede' THEN CAST(first_out AS VARCHAR) END AS superseded_by,
              n.acts - 1 - CASE WHEN first_out IS NULL THEN 0 ELSE 1 END AS refused
       FROM ins i JOIN acts x ON x.event_id = first_in JOIN n ON n.memory_id = i.memory_id
       LEFT JOIN outs o ON o.memory_id = i.memory_id LEFT JOIN acts y ON y.event_id = first_out""",
)
def memory_state_fold(spark, sf):
    return m.fold_acts(a.memory_acts(spark, sf))


LISTED = ["memory_id", "statement", "admitted_at", "subject_kind", "state"]


@query(
    "memory_list",
    ctes(v.MEMORIES)
    + f"""SELECT {', '.join(LISTED)} FROM memories WHERE repository_path = '{a.HOME}' AND state = 'active'
          ORDER BY admitted_epoch DESC, admitted_at DESC, memory_id LIMIT 20""",
)
def memory_list(spark, sf):
    return m.list_memories(a.memories(spark, sf, a.HOME_NUMBER), a.HOME).select(*LISTED)


@query(
    "memory_foreign",
    ctes(v.MEMORIES)
    + f"SELECT repository_path, count(*) AS memories FROM memories WHERE repository_path <> '{a.HOME}' GROUP BY 1",
)
def memory_foreign(spark, sf):
    return m.foreign_memories(a.memories(spark, sf), a.HOME)


@query(
    "memory_supersede_chain",
    ctes(v.MEMORIES)
    + """SELECT n.memory_id, n.state, n.superseded_by, o.memory_id AS supersedes
         FROM memories n LEFT JOIN memories o ON o.superseded_by = n.memory_id""",
)
def memory_supersede_chain(spark, sf):
    return m.supersede_links(a.memories(spark, sf))


@query(
    "memory_act_refusals",
    ctes(v.MEMORIES)
    + """SELECT memory_id, CASE WHEN length(statement) > 9 THEN 'statement is empty'
             WHEN subject_kind = 'path' AND subject_path = 's7' THEN 'subject has no path'
             WHEN subject_kind = 'repository' AND CAST(memory_id AS BIGINT) % 3 = 0 THEN 'subject has a path too many'
             WHEN subject_kind = 'repository' AND CAST(memory_id AS BIGINT) % 3 = 1 THEN 'subject has a commit too many'
             WHEN subject_kind = 'path' AND CAST(memory_id AS BIGINT) % 5 = 0 THEN 'subject has a name too many'
             ELSE 'since is not a day' END AS refusal
         FROM memories WHERE length(statement) > 9 OR (subject_kind = 'path' AND subject_path = 's7')
           OR (subject_kind = 'repository' AND CAST(memory_id AS BIGINT) % 3 < 2)
           OR (subject_kind = 'path' AND CAST(memory_id AS BIGINT) % 5 = 0)
           OR since_date LIKE '%-02-1%'""",
)
def memory_act_refusals(spark, sf):
    broken = (
        a.memories(spark, sf)
        .withColumn("statement", F.when(F.length("statement") > 9, "  ").otherwise(F.col("statement")))
        .withColumn(
            "subject_path",
            F.when(~((F.col("subject_kind") == "path") & (F.col("subject_path") == "s7")), F.col("subject_path")),
        )
        .withColumn("since_date", F.regexp_replace("since_date", "-02-1", "-02-3"))
    )
    # One fault more for each way a subject can hold what its kind does not.
    number, kind = F.col("memory_id").cast("long"), F.col("subject_kind")
    of_all = kind == "repository"
    broken = (
        broken.withColumn("subject_path", F.when(of_all & (number % 3 == 0), "p").otherwise(F.col("subject_path")))
        .withColumn("subject_commit_sha", F.when(of_all & (number % 3 == 1), "c").otherwise(F.col("subject_commit_sha")))
        .withColumn(
            "subject_qualname", F.when((kind == "path") & (number % 5 == 0), "q").otherwise(F.col("subject_qualname"))
        )
    )
    return m.act_refusals(broken)


# The unit the memories are held against: the commit with the most files.
UNIT = """
unit AS (SELECT commit_sha, committed_epoch FROM files GROUP BY ALL
         ORDER BY count(*) DESC, commit_sha LIMIT 1),
ranked AS (
  SELECT mm.*, CASE
      WHEN subject_kind = 'commit' AND subject_commit_sha = (SELECT commit_sha FROM unit) THEN 0
      WHEN subject_kind = 'definition' AND subject_qualname IN (
        SELECT qualname FROM defs WHERE commit_sha = (SELECT commit_sha FROM unit)) THEN 1
      WHEN subject_kind = 'path' AND subject_path IN (
        SELECT path FROM files WHERE commit_sha = (SELECT commit_sha FROM unit)) THEN 2
      WHEN memory_id IN (SELECT memory_id FROM citations, unit WHERE kind = 'commit'
                         AND starts_with(commit_sha, ref)) THEN 3
      WHEN subject_kind = 'repository' THEN 4 END AS rank
  FROM memories mm)"""


def _unit(spark, sf):
    files = a.commit_files(spark, sf).select("commit_sha", "committed_epoch", "path")
    widest = (
        files.groupBy("commit_sha", "committed_epoch")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "commit_sha")
        .limit(1)
        .collect()
    )
    sha, epoch = (widest[0]["commit_sha"], widest[0]["committed_epoch"]) if widest else ("", 0)
    mine = files.where(F.col("commit_sha") == sha)
    names = a.definition_rows(spark, sf).where(F.col("commit_sha") == sha)
    return sha, epoch, mine, names


def _related(spark, sf):
    sha, epoch, files, names = _unit(spark, sf)
    one = spark.createDataFrame([(sha,)], "sha string")
    return epoch, m.related(
        a.memories(spark, sf), a.memory_citations(spark, sf), one, files.select("path"), names.select("qualname")
    )


RELATED = ctes(v.MEMORIES, v.CITATIONS, v.FILES, v.DEFINITIONS, UNIT)


@query("memory_relation_rank", RELATED + "SELECT memory_id, subject_kind, rank FROM ranked WHERE rank IS NOT NULL")
def memory_relation_rank(spark, sf):
    return _related(spark, sf)[1].select("memory_id", "subject_kind", "rank")


# The given keys begin with zeros: this many of their 19 digits name a handful of commits.
START_LETTERS = 18

IN_FORCE = f"""
starts AS (SELECT substring(sha, 1, {START_LETTERS}) AS beginning, max(committed_epoch) AS committed_epoch
           FROM commits GROUP BY 1),
held AS (
  SELECT r.*, c.committed_epoch AS since_epoch,
    coalesce(CASE WHEN since_commit_sha IS NOT NULL THEN c.committed_epoch <= u.committed_epoch
                  WHEN since_date IS NOT NULL
                    THEN since_date <= strftime(to_timestamp(u.committed_epoch) AT TIME ZONE 'UTC', '%Y-%m-%d')
                  ELSE false END, false)
      AND (ended_epoch IS NULL OR ended_epoch >= u.committed_epoch) AS in_force
  FROM ranked r CROSS JOIN unit u LEFT JOIN starts c ON c.beginning = substring(r.since_commit_sha, 1, {START_LETTERS})
  WHERE rank IS NOT NULL)"""


def _started(spark, sf, epoch, ranked):
    at = F.date_format(F.timestamp_seconds(F.lit(epoch)), "yyyy-MM-dd")
    return m.in_force(ranked, a.commits(spark, sf), F.lit(epoch), at, letters=START_LETTERS)


@query(
    "memory_in_force",
    ctes(v.MEMORIES, v.CITATIONS, v.FILES, v.DEFINITIONS, UNIT, IN_FORCE)
    + "SELECT memory_id, rank, since_epoch, in_force FROM held",
)
def memory_in_force(spark, sf):
    found = _started(spark, sf, *_related(spark, sf))
    return found.select("memory_id", "rank", "since_epoch", "in_force")


@query(
    "memory_section",
    ctes(v.MEMORIES, v.CITATIONS, v.FILES, v.DEFINITIONS, UNIT, IN_FORCE)
    + """SELECT memory_id, rank, in_force, (SELECT greatest(count(*) - 5, 0) FROM held) AS omitted
         FROM held ORDER BY rank, admitted_epoch DESC, memory_id LIMIT 5""",
)
def memory_section(spark, sf):
    epoch, ranked = _related(spark, sf)
    shown, left = m.section(ranked)
    # The rows that are shown are few: only their starts are looked up.
    shown = _started(spark, sf, epoch, shown)
    # One row.
    return shown.join(F.broadcast(left)).select("memory_id", "rank", "in_force", "omitted")


CITED = ctes(v.MEMORIES, v.CITATIONS, v.FILE_LIVES, v.DEFINITIONS, v.RANGES) + """,
cur AS (SELECT life_id, arg_max(path, seq) AS current_path FROM ev GROUP BY 1),
pre AS (SELECT DISTINCT ref FROM citations WHERE kind = 'commit'),
oncommit AS (SELECT ref, max(sha) AS sha FROM pre JOIN commits
             ON substring(sha, 1, 18) = substring(ref, 1, 18) AND starts_with(sha, ref) GROUP BY ref),
firsts AS (SELECT memory_id, arg_min(ref, (position, ref)) AS ref FROM citations WHERE kind = 'commit' GROUP BY 1),
touched AS (SELECT DISTINCT commit_sha, life_id FROM ev WHERE commit_sha IN (
              SELECT commit_sha FROM ev GROUP BY 1 HAVING count(DISTINCT life_id) <= 100)),
wanted AS (SELECT DISTINCT ref, split_part(ref, ' -> ', 1) AS pa, split_part(ref, ' -> ', 2) AS pb
           FROM citations WHERE kind = 'cochange'),
pairs AS (SELECT DISTINCT w.ref, e.life_id AS la, c.life_id AS lb FROM wanted w
          JOIN (SELECT DISTINCT path, life_id FROM ev) e ON e.path = pa
          JOIN cur c ON c.current_path = pb WHERE e.life_id <> c.life_id),
met AS (SELECT p.ref FROM pairs p JOIN touched x ON x.life_id = la
        JOIN touched y ON y.life_id = lb AND y.commit_sha = x.commit_sha
        GROUP BY p.ref, la, lb HAVING count(*) >= 2),
resolved AS (
  SELECT c.memory_id, c.position, c.kind, c.ref, CASE WHEN CASE c.kind
    WHEN 'commit' THEN c.ref IN (SELECT ref FROM oncommit)
    WHEN 'file' THEN substring(c.ref, 3) IN (SELECT path FROM files)
    WHEN 'definition' THEN c.ref IN (SELECT qualname FROM defs)
    WHEN 'absence' THEN c.ref = 'merge_no_diff'
    WHEN 'cochange' THEN c.ref IN (SELECT ref FROM met)
    ELSE EXISTS (SELECT 1 FROM firsts f JOIN oncommit o ON o.ref = f.ref JOIN ranges r ON r.commit_sha = o.sha
                 WHERE f.memory_id = c.memory_id AND c.ref = printf('%s:%d-%d', r.path, r.start, r."end"))
    END THEN 'resolved' ELSE 'unresolved' END AS resolution
FROM citations c)"""


def _cited(spark, sf):
    """(commits, events, definitions, citations with their resolution)."""
    lives = lc.lifecycle_events(a.order_sequence(spark, sf), renames=False)
    events, commits, names = lives.stored("lives").frame, a.commits(spark, sf), a.definition_rows(spark, sf)
    resolved = m.resolve_citations(
        a.memory_citations(spark, sf, parts=True), commits, events, names,
        lambda of: a.patch_ranges(spark, sf, of), lc.file_statistics(events),
    )
    return commits, events, names, resolved


@query("citation_resolution", CITED + " SELECT memory_id, kind, ref, resolution FROM resolved")
def citation_resolution(spark, sf):
    return _cited(spark, sf)[-1].select("memory_id", "kind", "ref", "resolution")


@query(
    "memory_act_citations",
    CITED
    + """, missing AS (
  SELECT memory_id, arg_min(kind || ' ' || ref, (position, kind, ref)) AS what
  FROM resolved WHERE resolution = 'unresolved' GROUP BY 1),
told AS (
  SELECT m.memory_id, CASE
      WHEN subject_kind = 'path' AND subject_path NOT IN (SELECT path FROM files) THEN 'subject not found: path'
      WHEN subject_kind = 'definition' AND (subject_path, subject_qualname) NOT IN (SELECT (path, qualname) FROM defs)
        THEN 'subject not found: definition'
      WHEN subject_kind = 'commit' AND subject_commit_sha NOT IN (SELECT sha FROM commits) THEN 'subject not found: commit'
      WHEN since_commit_sha NOT IN (SELECT sha FROM commits) THEN 'start not found'
      ELSE 'citation not found: ' || what END AS refusal
  FROM memories m LEFT JOIN missing USING (memory_id))
SELECT memory_id, refusal FROM told WHERE refusal IS NOT NULL""",
)
def memory_act_citations(spark, sf):
    """Every statement as an act: what a write refuses it for."""
    commits, events, names, resolved = _cited(spark, sf)
    return m.unheld(m.resolve_subjects(a.memories(spark, sf), commits, events, names), resolved)


# ------------------------------------------------------------------ interchange


def _incoming(spark, sf):
    """The store's own rows as a file would bring them: some changed, some new."""
    k = F.col("memory_id").cast("long")
    return (
        a.memories(spark, sf)
        .withColumn("statement", F.when(k % 11 == 0, F.concat("statement", F.lit("!"))).otherwise(F.col("statement")))
        .withColumn("author_email", F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("author_email")))
        .withColumn("state", F.when(k % 17 == 0, "active").otherwise(F.col("state")))
        .withColumn("superseded_by", F.when(k % 19 == 0, F.concat("memory_id", F.lit("x"))).otherwise(F.col("superseded_by")))
        .withColumn("memory_id", F.when(k % 7 == 0, F.concat("memory_id", F.lit("n"))).otherwise(F.col("memory_id")))
    )


@query(
    "import_plan",
    ctes(v.MEMORIES)
    + """SELECT CASE WHEN k % 7 = 0 THEN memory_id || 'n' ELSE memory_id END AS memory_id,
           CASE WHEN k % 7 = 0 THEN 'insert' WHEN diff IS NULL THEN 'skip' ELSE 'conflict' END AS decision,
           CASE WHEN k % 7 <> 0 THEN diff END AS difference
         FROM (SELECT *, CAST(memory_id AS BIGINT) AS k,
                 CASE WHEN CAST(memory_id AS BIGINT) % 11 = 0 THEN 'statement'
                      WHEN CAST(memory_id AS BIGINT) % 13 = 0 AND author_email IS NOT NULL THEN 'author'
                      WHEN CAST(memory_id AS BIGINT) % 17 = 0 AND state <> 'active' THEN 'state'
                      WHEN CAST(memory_id AS BIGINT) % 19 = 0 THEN 'superseded_by' END AS diff
               FROM memories)""",
)
def import_plan(spark, sf):
    return ix.import_plan(_incoming(spark, sf), a.memories(spark, sf))


@query(
    "import_dangling",
    ctes(v.MEMORIES)
    + """SELECT CASE WHEN k % 7 = 0 THEN memory_id || 'n' ELSE memory_id END AS memory_id,
           memory_id || 'x' AS superseded_by
         FROM (SELECT *, CAST(memory_id AS BIGINT) AS k FROM memories) WHERE k % 19 = 0""",
)
def import_dangling(spark, sf):
    return ix.dangling_successors(_incoming(spark, sf), a.memories(spark, sf)).select("memory_id", "superseded_by")


@query(
    "import_cycles",
    ctes(v.MEMORIES)
    + """SELECT memory_id FROM (
           SELECT memory_id, CAST(author_name[2:] AS BIGINT) AS c, state FROM memories)
         WHERE c % 50 = 0 AND c IN (SELECT c FROM (
           SELECT CAST(author_name[2:] AS BIGINT) AS c FROM memories) GROUP BY c HAVING count(*) > 1)""",
)
def import_cycles(spark, sf):
    """Every fiftieth customer's orders linked in a ring; the rest as a straight chain."""
    linked = a.commit_parents(spark, sf).where("position = 0").select(
        F.col("parent_sha").alias("memory_id"), F.col("commit_sha").alias("superseded_by")
    )
    ends = (
        a.commits(spark, sf)
        .groupBy("author_name")
        .agg(
            F.min(F.struct("committed_epoch", "sha")).alias("_f"),
            F.max(F.struct("committed_epoch", "sha")).alias("_l"),
        )
        .where("cast(author_name as bigint) % 50 = 0 and _f.sha <> _l.sha")
        .select(F.col("_l.sha").alias("memory_id"), F.col("_f.sha").alias("superseded_by"))
    )
    return ix.never_ending_chains(linked.unionByName(ends))


@query(
    "export_lines",
    ctes(v.MEMORIES, v.CITATIONS)
    + """, listed AS (SELECT memory_id, string_agg('{"kind": "' || kind || '", "ref": "' || ref || '"}', ', '
                             ORDER BY position, kind, ref) AS cites FROM citations GROUP BY 1)
SELECT m.memory_id, '{"memory_id": "' || m.memory_id || '", "repository": "' || repository_path
    || '", "statement": "' || statement || '", "author": {"name": "' || author_name || '", "email": '
    || coalesce('"' || author_email || '"', 'null') || '}, "admitted_at": "' || admitted_at || '", "state": "'
    || state || '", "subject": ' || CASE subject_kind
         WHEN 'definition' THEN '{"kind": "definition", "path": "' || subject_path || '", "qualname": "' || subject_qualname || '"}'
         WHEN 'commit' THEN '{"kind": "commit", "commit": "' || subject_commit_sha || '"}'
         WHEN 'path' THEN '{"kind": "path", "path": "' || subject_path || '"}'
         ELSE '{"kind": "repository"}' END
    || ', "since": ' || CASE WHEN since_commit_sha IS NOT NULL THEN '{"commit": "' || since_commit_sha || '"}'
         WHEN since_date IS NOT NULL THEN '{"date": "' || since_date || '"}' ELSE 'null' END
    || ', "ended_at": ' || coalesce('"' || strftime(make_timestamp(ended_epoch * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00"', 'null')
    || ', "end_reason": ' || coalesce('"' || end_reason || '"', 'null')
    || ', "superseded_by": ' || coalesce('"' || superseded_by || '"', 'null')
    || ', "citations": [' || coalesce(cites, '') || ']}' AS line
FROM memories m LEFT JOIN listed l ON l.memory_id = m.memory_id""",
)
def export_lines(spark, sf):
    held = ix.with_citations(a.memories(spark, sf), a.memory_citations(spark, sf).drop(REPO))
    return ix.memory_lines(held)


FAULTS = [
    None,
    "the line has a key the format does not have",
    "the line lacks a key",
    "the id is not a canonical uuid",
    "the statement is empty or over 4000 characters",
    "the moment has no offset or is not one",
    "the state is unknown",
    "a subject holds what its kind does not",
    "a key inside the subject is unknown",
    "two kinds of since",
    "a citation is given twice",
    "the row is about another repository",
    "the line is blank or not a JSON object",
    "a key inside a citation is unknown",
]


@query(
    "import_line_violations",
    "SELECT line_no, rule FROM (SELECT o_orderkey AS line_no, CASE o_orderkey % 14 "
    + " ".join(f"WHEN {i} THEN '{rule}'" for i, rule in enumerate(FAULTS) if rule)
    + " END AS rule FROM orders) WHERE rule IS NOT NULL",
)
def import_line_violations(spark, sf):
    """Orders as lines of an export, each with one fault or none."""
    k = F.col("o_orderkey")
    fault = k % len(FAULTS)
    at = lambda n, bad, good: F.when(fault == n, bad).otherwise(good)
    quoted = lambda text: F.concat(F.lit('"'), text, F.lit('"'))
    number = F.lpad(k.cast("string"), 12, "0")
    moment = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    cite = '{"kind":"commit","ref":"abc"}'
    line = F.concat(
        F.lit('{"memory_id":'), quoted(F.concat(at(3, "X", "0"), F.lit("0000000-0000-4000-8000-"), number)),
        F.lit(',"repository":'), quoted(at(11, "elsewhere", "here")),
        F.lit(',"statement":'), quoted(at(4, "  ", F.col("o_orderpriority"))),
        F.lit(',"author":{"name":null,"email":"a@x"},"admitted_at":'), quoted(at(5, "2024-13-45T99:99:99+00:00", moment)),
        at(2, "", F.concat(F.lit(',"state":'), quoted(at(6, "lost", "active")))),
        F.lit(',"subject":{"kind":"repository","path":'), at(7, '"p"', "null"), F.lit(',"qualname":null,"commit":null'),
        at(8, ',"colour":"red"', ""),
        F.lit('},"since":{"commit":'), at(9, '"abc"', "null"), F.lit(',"date":"2024-02-10"}'),
        F.lit(',"ended_at":null,"end_reason":null,"superseded_by":null,"citations":['),
        F.when(fault == 10, f"{cite},{cite}").when(fault == 13, '{"kind":"commit","ref":"abc","note":"x"}').otherwise(cite),
        F.lit("]"), at(1, ',"more":1', ""), at(12, "", "}"),
    )
    lines = a.table(spark, sf, "orders").select(k.alias("line_no"), line.alias("line"))
    return ix.line_violations(ix.document_of(lines), "here")
