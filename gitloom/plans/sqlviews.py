"""SQL twins of ``gitloom.sources.adapters``, as CTE text for the oracle."""

COMMITS = """
commits AS (
  SELECT 'orders' AS repo_id, lpad(CAST(o_orderkey AS VARCHAR), 19, '0') AS sha,
         CAST(o_custkey AS VARCHAR) AS author_name, CAST(o_custkey AS VARCHAR) || '@' || CAST(o_custkey % 7 AS VARCHAR) AS author_email,
         strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS authored_at,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS committed_at,
         CAST(epoch(o_orderdate) AS BIGINT) AS committed_epoch,
         o_orderpriority AS message, o_orderstatus AS status
  FROM orders)"""

PARENTS = """
linked AS (
  SELECT sha, status,
         lag(sha) OVER (PARTITION BY author_name ORDER BY committed_epoch, sha) AS p1,
         last_value(CASE WHEN status = 'F' THEN sha END IGNORE NULLS) OVER (
           PARTITION BY author_name ORDER BY committed_epoch, sha
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p2
  FROM commits),
parents AS (
  SELECT sha AS commit_sha, 0 AS position, p1 AS parent_sha FROM linked WHERE p1 IS NOT NULL
  UNION ALL
  SELECT sha, 1, p2 FROM linked WHERE status = 'P' AND p2 <> p1)"""

FILES = """
changed AS (
  SELECT l_orderkey, l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS q,
         CAST(sum(l_linenumber) AS BIGINT) AS n, min(l_tax) AS tax, min(l_returnflag) AS flag
  FROM lineitem GROUP BY ALL),
dated AS (
  SELECT c.*, o_orderdate,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY o_orderdate, l_orderkey) AS nth
  FROM changed c JOIN orders ON o_orderkey = l_orderkey),
files AS (
  SELECT 'orders' AS repo_id, lpad(CAST(l_orderkey AS VARCHAR), 19, '0') AS commit_sha,
         's' || CAST(l_suppkey AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS old_path,
         CASE WHEN nth = 1 THEN 'A' WHEN flag = 'R' THEN 'D' ELSE 'M' END AS change_type,
         CASE WHEN tax <> 0 THEN q END AS added_lines,
         CASE WHEN tax <> 0 THEN n END AS deleted_lines,
         CAST(epoch(o_orderdate) AS BIGINT) AS committed_epoch
  FROM dated)"""

# Without renames a life starts at an A, or at the first event of the path unless
# that one is a deletion, which is then a life by itself.
FILE_LIVES = FILES + """,
seqd AS (
  SELECT *, row_number() OVER (ORDER BY committed_epoch, commit_sha, path) AS seq FROM files),
ev AS (
  SELECT *, coalesce(
      last_value(CASE WHEN change_type = 'A' THEN seq END IGNORE NULLS) OVER w,
      min(CASE WHEN change_type <> 'D' THEN seq END) OVER w, seq) AS life_id
  FROM seqd
  WINDOW w AS (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

RENAMES = """
log AS (
  SELECT event_id, ts, value, user_id,
         CASE event_type WHEN 'signup' THEN 'A' WHEN 'error' THEN 'D' WHEN 'purchase' THEN 'R'
                         ELSE 'M' END AS change_type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
renames AS (
  SELECT 'events' AS repo_id, lpad(CAST(event_id AS VARCHAR), 19, '0') AS commit_sha,
         CASE WHEN change_type = 'R' THEN 'u' || CAST(k AS VARCHAR)
              ELSE 'u' || CAST(user_id AS VARCHAR) END AS path,
         CASE WHEN change_type = 'R' THEN 'u' || CAST(user_id AS VARCHAR) END AS old_path,
         change_type,
         CASE WHEN k % 10 <> 0 THEN CAST(floor(value) AS BIGINT) END AS added_lines,
         CASE WHEN k % 10 <> 0 THEN k END AS deleted_lines,
         CASE WHEN change_type = 'R' THEN CAST(50 + k % 51 AS INTEGER) END AS similarity,
         CAST(floor(epoch(ts)) AS BIGINT) AS committed_epoch, event_id
  FROM log)"""

RENAME_LIVES = RENAMES + """,
seqd AS (SELECT *, event_id AS seq FROM renames),
started AS (
  SELECT *, CASE WHEN change_type <> 'D' AND (change_type IN ('A', 'R') OR NOT coalesce(
      bool_or(change_type <> 'D') OVER (PARTITION BY path ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) THEN 1 ELSE 0 END AS starter
  FROM seqd),
numbered AS (
  SELECT *, sum(starter) OVER (PARTITION BY path ORDER BY seq
                               ROWS UNBOUNDED PRECEDING) AS n FROM started),
seg AS (
  SELECT *, CASE WHEN n = 0 THEN path || '#' || seq || '#alone' ELSE path || '#' || n END AS seg_id
  FROM numbered),
asked AS (
  SELECT seq, path AS held, seg_id, 0 AS ask FROM seg WHERE change_type <> 'D'
  UNION ALL
  SELECT seq, old_path, NULL, 1 FROM seg WHERE change_type = 'R'),
answered AS (
  SELECT seq, ask, last_value(seg_id IGNORE NULLS) OVER (
    PARTITION BY held ORDER BY seq, ask DESC ROWS UNBOUNDED PRECEDING) AS parent FROM asked),
edge AS (
  SELECT s.seg_id AS child, a.parent FROM seg s JOIN answered a ON a.seq = s.seq AND a.ask = 1
  WHERE s.change_type = 'R' AND a.parent IS NOT NULL),
root AS (
  SELECT DISTINCT seg_id AS node, seg_id AS top FROM seg
  WHERE seg_id NOT IN (SELECT child FROM edge)
  UNION ALL
  SELECT e.child, r.top FROM edge e JOIN root r ON e.parent = r.node),
ev AS (
  SELECT s.*, min(s.seq) OVER (PARTITION BY r.top) AS life_id
  FROM seg s JOIN root r ON r.node = s.seg_id)"""

MOVED = "coalesce(added_lines, 0) + coalesce(deleted_lines, 0)"
EDIT = f"(change_type = 'M' OR (change_type = 'R' AND {MOVED} > 0))"

STATISTICS = f"""
stats AS (
  SELECT repo_id, life_id,
         arg_max(path, seq) AS current_path,
         arg_min(committed_epoch, seq) AS created_epoch,
         arg_min(commit_sha, seq) AS created_sha,
         arg_max(committed_epoch, seq) FILTER (WHERE {EDIT}) AS last_modified_epoch,
         arg_max(commit_sha, seq) FILTER (WHERE {EDIT}) AS last_modified_sha,
         count(*) AS commits,
         count(*) FILTER (WHERE {EDIT}) AS modifications,
         count(*) FILTER (WHERE change_type = 'R') AS renames,
         CAST(sum(coalesce(added_lines, 0)) AS BIGINT) AS additions,
         CAST(sum(coalesce(deleted_lines, 0)) AS BIGINT) AS deletions,
         count(*) FILTER (WHERE added_lines IS NULL AND deleted_lines IS NULL) AS binary_changes,
         arg_max(change_type, seq) = 'D' AS is_deleted,
         CASE WHEN arg_max(change_type, seq) = 'D' THEN arg_max(commit_sha, seq) END AS deleted_sha,
         CASE WHEN arg_max(change_type, seq) = 'D' THEN arg_max(committed_epoch, seq) END
           AS deleted_epoch
  FROM ev GROUP BY repo_id, life_id),
statistics AS (
  SELECT *, additions - deletions AS net_change, additions + deletions AS churn FROM stats)"""

NAMES = """
named AS (
  SELECT *, lag(path) OVER (PARTITION BY repo_id, life_id ORDER BY seq) AS was FROM ev),
names AS (SELECT repo_id, life_id, seq, path FROM named WHERE was IS NULL OR was <> path)"""

STEPS = """
events_ AS (
  SELECT o_custkey AS life_id, lpad(CAST(o_orderkey AS VARCHAR), 19, '0') AS commit_sha,
         'c' || CAST(o_custkey AS VARCHAR) || '.py' AS path,
         o_orderstatus AS st, o_orderpriority AS pr,
         row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back
  FROM orders),
told AS (
  SELECT *, CASE WHEN st = 'O' AND pr = '1-URGENT' AND back = 1 THEN 'file_end'
                 WHEN st = 'O' AND pr = '1-URGENT' THEN 'not_in_tree'
                 WHEN st = 'P' AND pr = '5-LOW' THEN 'not_stored'
                 WHEN st = 'P' THEN 'parse_failed' ELSE 'read' END AS state
  FROM events_),
steps AS (
  SELECT *, CAST(sum(CASE WHEN state IN ('read', 'file_end') THEN 1 ELSE 0 END) OVER w AS BIGINT)
              AS step,
         last_value(CASE WHEN state = 'read' THEN commit_sha END IGNORE NULLS) OVER (
           PARTITION BY life_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
           AS previous_commit_sha
  FROM told
  WINDOW w AS (PARTITION BY life_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
compared AS (SELECT * FROM steps WHERE state IN ('read', 'file_end')),
gaps AS (SELECT life_id, step + 1 AS step, seq, commit_sha, path, state
         FROM steps WHERE state NOT IN ('read', 'file_end')),
width AS (SELECT life_id, step, count(*) AS blind_spots FROM gaps GROUP BY ALL)"""

DEFINITIONS = """
defs AS (
  SELECT lpad(CAST(l_orderkey AS VARCHAR), 19, '0') AS commit_sha,
         'c' || CAST(o_custkey AS VARCHAR) || '.py' AS path,
         CASE WHEN l_linestatus = 'F' THEN 'class' WHEN l_returnflag = 'A' THEN 'async function'
              ELSE 'function' END AS kind,
         CASE WHEN l_linestatus = 'F' THEN p_type
              WHEN l_returnflag = 'A' THEN p_type || '.run.<locals>.' || p_brand
              ELSE p_type || '.' || p_brand END AS qualname,
         CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '/'
           || CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) AS fingerprint,
         l_linenumber AS lineno, l_linenumber + CAST(l_quantity AS INTEGER) AS end_lineno,
         l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
occ AS (
  SELECT *, row_number() OVER (PARTITION BY commit_sha, path, kind, qualname
      ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount) - 1 AS occurrence
  FROM defs)"""

DEFINITION_EVENTS = STEPS + "," + DEFINITIONS + """,
held AS (
  SELECT s.life_id, s.step, o.kind, o.qualname, o.occurrence, o.commit_sha, o.path,
         s.previous_commit_sha, o.fingerprint, o.lineno, o.end_lineno
  FROM occ o JOIN steps s ON s.commit_sha = o.commit_sha AND s.path = o.path AND s.state = 'read'),
here AS (
  SELECT h.*, CASE WHEN b.life_id IS NULL THEN 'created' ELSE 'modified' END AS change
  FROM held h LEFT JOIN held b ON b.life_id = h.life_id AND b.step = h.step - 1
    AND b.kind = h.kind AND b.qualname = h.qualname AND b.occurrence = h.occurrence
  WHERE b.life_id IS NULL OR b.fingerprint <> h.fingerprint),
gone AS (
  SELECT h.life_id, c.step, h.kind, h.qualname, h.occurrence, c.commit_sha, c.path,
         c.previous_commit_sha
  FROM held h JOIN compared c ON c.life_id = h.life_id AND c.step = h.step + 1
  WHERE NOT EXISTS (SELECT 1 FROM held n WHERE n.life_id = h.life_id AND n.step = h.step + 1
    AND n.kind = h.kind AND n.qualname = h.qualname AND n.occurrence = h.occurrence)),
both_ AS (
  SELECT life_id, step, kind, qualname, occurrence, commit_sha, path, previous_commit_sha, change,
         lineno, end_lineno FROM here
  UNION ALL
  SELECT life_id, step, kind, qualname, occurrence, commit_sha, path, previous_commit_sha,
         'deleted', NULL, NULL FROM gone),
devents AS (
  SELECT b.*, coalesce(w.blind_spots, 0) AS blind_spots
  FROM both_ b LEFT JOIN width w ON w.life_id = b.life_id AND w.step = b.step),
dlives AS (
  SELECT life_id, kind, qualname, occurrence, count(*) AS events, min(step) AS first_step,
         arg_max(change, step) AS last_change, arg_max(commit_sha, step) AS last_commit_sha
  FROM devents GROUP BY ALL),
tails AS (
  SELECT m.life_id, w.blind_spots FROM (SELECT life_id, max(step) AS m FROM compared GROUP BY 1) m
  JOIN width w ON w.life_id = m.life_id AND w.step = m.m + 1)"""

MEMORIES = COMMITS + "," + PARENTS + """,
follows AS (SELECT p.parent_sha AS memory_id, p.commit_sha AS nxt, c.committed_epoch AS nxt_epoch
            FROM parents p JOIN commits c ON c.sha = p.commit_sha WHERE position = 0),
memories AS (
  SELECT 'orders' AS repo_id, lpad(CAST(o_orderkey AS VARCHAR), 19, '0') AS memory_id,
    'repo' || CAST(o_custkey % 7 AS VARCHAR) AS repository_path, o_orderpriority AS statement,
    'c' || CAST(o_custkey AS VARCHAR) AS author_name,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) || '@x' END AS author_email,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS admitted_at,
    CAST(epoch(o_orderdate) AS BIGINT) AS admitted_epoch,
    CASE o_orderkey % 4 WHEN 0 THEN 'commit' WHEN 1 THEN 'definition' WHEN 2 THEN 'path'
                        ELSE 'repository' END AS subject_kind,
    CASE WHEN o_orderkey % 4 IN (1, 2) THEN 's' || CAST(o_custkey % 100 AS VARCHAR) END AS subject_path,
    CASE WHEN o_orderkey % 4 = 1 THEN 'ECONOMY.Brand#' || CAST(o_orderkey % 25 AS VARCHAR) END
      AS subject_qualname,
    CASE WHEN o_orderkey % 4 = 0 THEN lpad(CAST(o_orderkey * 3 AS VARCHAR), 19, '0') END
      AS subject_commit_sha,
    CASE WHEN o_orderkey % 3 = 0 THEN lpad(CAST(o_orderkey * 2 AS VARCHAR), 19, '0') END
      AS since_commit_sha,
    CASE WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS since_date,
    CASE WHEN o_orderstatus = 'O' AND nxt IS NOT NULL THEN 'superseded'
         WHEN o_orderstatus = 'P' THEN 'invalidated' ELSE 'active' END AS state,
    CASE WHEN o_orderstatus = 'O' AND nxt IS NOT NULL THEN nxt_epoch
         WHEN o_orderstatus = 'P' THEN CAST(epoch(o_orderdate) AS BIGINT) + 2592000 END AS ended_epoch,
    CASE WHEN o_orderstatus = 'P' THEN 'no longer true' END AS end_reason,
    CASE WHEN o_orderstatus = 'O' THEN nxt END AS superseded_by
  FROM orders LEFT JOIN follows ON memory_id = lpad(CAST(o_orderkey AS VARCHAR), 19, '0'))"""

CITATIONS = """
cited AS (
  SELECT lpad(CAST(l_orderkey AS VARCHAR), 19, '0') AS memory_id, l_linenumber AS position,
    CASE l_partkey % 6 WHEN 0 THEN 'commit' WHEN 1 THEN 'file' WHEN 2 THEN 'definition'
      WHEN 3 THEN 'range' WHEN 4 THEN 'absence' ELSE 'cochange' END AS kind,
    CASE l_partkey % 6
      WHEN 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN lpad(CAST(l_orderkey AS VARCHAR), 19, '0')
                  ELSE substring(lpad(CAST(l_orderkey * 2 AS VARCHAR), 19, '0'), 1, 18) END
      WHEN 1 THEN './s' || CAST(l_suppkey * 2 AS VARCHAR)
      WHEN 2 THEN 'ECONOMY.Brand#' || CAST(l_partkey % 40 AS VARCHAR)
      WHEN 3 THEN printf('s%d:%d-%d', l_suppkey, l_linenumber,
                         l_linenumber + CAST(l_quantity AS INTEGER) - 1)
      WHEN 4 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'merge_no_diff' ELSE 'nothing' END
      ELSE 's' || CAST(l_suppkey AS VARCHAR) || ' -> s' || CAST(l_suppkey % 50 + 1 AS VARCHAR)
    END AS ref
  FROM lineitem),
citations AS (SELECT memory_id, kind, ref, min(position) AS position FROM cited GROUP BY ALL)"""

RANGES = """
ranges AS (
  SELECT lpad(CAST(l_orderkey AS VARCHAR), 19, '0') AS commit_sha, l_partkey,
         's' || CAST(l_suppkey AS VARCHAR) AS path, l_linenumber AS start,
         l_linenumber + CAST(l_quantity AS INTEGER) - 1 AS "end" FROM lineitem WHERE l_quantity > 0
  UNION ALL
  SELECT lpad(CAST(l_orderkey AS VARCHAR), 19, '0'), l_partkey, 's' || CAST(l_suppkey AS VARCHAR),
         l_linenumber + CAST(l_quantity AS INTEGER) + 10,
         l_linenumber + CAST(l_quantity AS INTEGER) + 10 FROM lineitem)"""
