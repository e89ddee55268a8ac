"""File identities across renames, and the order commits are walked in."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitloom.operators.sequence import CHUNK, SEQ, Running, Sequence, crowded, ordered, running
from gitloom.session import materialise

REPO = "repo_id"
CREATED, MODIFIED, DELETED, RENAMED = "A", "M", "D", "R"


# ------------------------------------------------------------------ commit order


def walk_keys(commits: DataFrame, parents: DataFrame | None) -> DataFrame:
    """Give each commit a sortable ``walk_key``: parents first, then time, then sha.

    Always taking the smallest ready commit by (time, sha) means that a commit older than some
    ancestor is walked among those that this ancestor set free. So a commit's key is the list of the
    ancestors it waited for, each older than the one before, and itself at the end: of its parent
    walked last, the list's elements younger than the commit, then the commit. Keys compare element
    by element, the shorter first. Where no parent is younger than its child, which one join
    establishes, the key is the commit alone.
    """
    own = F.struct(F.col("committed_epoch").alias("t"), F.col("sha").alias("s"))
    nodes = commits.select(REPO, "sha", own.alias("own"))
    alone = nodes.select(REPO, "sha", F.array("own").alias("walk_key"))
    if parents is None:
        return alone

    edges = parents.select(REPO, F.col("parent_sha").alias("p"), F.col("commit_sha").alias("c"))
    told = edges.join(nodes.select(REPO, F.col("sha").alias("p"), F.col("own").alias("po")), [REPO, "p"]).join(
        nodes.select(REPO, F.col("sha").alias("c"), F.col("own").alias("co")), [REPO, "c"]
    )
    # Read twice where a clock ran ahead; what links commits may have cost a walk over all of them.
    told = materialise(told, "walk-edges")
    skewed = materialise(told.where("po > co").select(REPO, "po", "co"), "skewed-edges")
    if skewed.limit(1).count() == 0:
        return alone
    waiting = materialise(_between_skewed_ends(nodes, skewed), "skewed-commits")
    known = materialise(told.join(waiting.select(REPO, F.col("sha").alias("c")), [REPO, "c"], "left_semi"), "skewed-parents")
    keys = _waited_for(waiting, known)
    return (
        nodes.join(keys, [REPO, "sha"], "left")
        .select(REPO, "sha", F.coalesce("path", F.array("own")).alias("walk_key"))
    )


def _between_skewed_ends(nodes: DataFrame, skewed: DataFrame) -> DataFrame:
    """The commits that may wait for a younger ancestor.

    On a path from that ancestor down to the commit some edge steps from above the commit's own
    (time, sha) to it or below: an edge with a younger parent, between whose ends the commit lies.
    """
    ends = skewed.select(REPO, F.col("co").alias("own"), F.lit(1).alias("_step")).unionByName(
        skewed.select(REPO, F.col("po").alias("own"), F.lit(-1).alias("_step"))
    )
    steps = ends.groupBy(REPO, "own").agg(F.sum("_step").alias("_step")).withColumn("_turn", F.lit(0))
    rows = nodes.withColumn("_turn", F.lit(1)).unionByName(steps, allowMissingColumns=True)
    line = ordered(rows, [REPO, "own", "_turn"])
    told = running(line, [REPO], [Running("_open", "sum", F.coalesce("_step", F.lit(0).cast("long")))])
    return told.where("_turn = 1 and _open > 0").select(REPO, "sha", "own")


def _waited_for(waiting: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, sha, path) of the waiting commits; *edges*: theirs to all their known parents.

    Each commit follows one of its parents, so that lists are put together by pointer doubling over
    a forest: what a stretch of the line adds is itself such a list. Then every merge looks whether
    another of its parents was walked later, and follows that one; lists only grow, so this ends.
    Only the trees of such merges are walked anew, and only what their commits offer is looked at again.
    A clock that runs backwards for a whole stretch gives lists as long as the stretch.
    """
    outside = (
        edges.select(REPO, F.col("p").alias("sha"), F.col("po").alias("own")).distinct()
        .join(waiting.select(REPO, "sha"), [REPO, "sha"], "left_anti")
    )
    nodes = materialise(waiting.unionByName(outside), "skewed-nodes")
    merges = materialise(
        edges.join(edges.groupBy(REPO, "c").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), [REPO, "c"], "left_semi"),
        "skewed-merges",
    )
    follows = edges.groupBy(REPO, F.col("c").alias("sha")).agg(F.min("p").alias("up"))
    alone = F.array("own").alias("path")
    paths = fresh = _along_the_forest(nodes.join(follows, [REPO, "sha"], "left").select(REPO, "sha", alone, "up", F.col("sha").alias("top")))
    while True:
        asked = merges.join(fresh.select(REPO, F.col("sha").alias("p"), F.col("path").alias("_above")), [REPO, "p"])
        offer = F.array_append(F.filter("_above", lambda x: x > F.col("co")), F.col("co"))
        best = asked.groupBy(REPO, F.col("c").alias("sha")).agg(F.max(F.struct(offer.alias("path"), "p")).alias("_best"))
        later = materialise(
            best.join(paths, [REPO, "sha"]).where("_best.path > path").select(REPO, "sha", "top", F.col("_best.p").alias("_up")),
            "walked-later",
        )
        if later.limit(1).count() == 0:
            return paths.select(REPO, "sha", "path")
        follows = materialise(
            follows.join(later.drop("top"), [REPO, "sha"], "left").select(REPO, "sha", F.coalesce("_up", "up").alias("up")), "follows"
        )
        trees = later.select(REPO, "top").distinct()
        again = materialise(
            paths.join(trees, [REPO, "top"], "left_semi").select(REPO, "sha").distinct()
            .join(nodes, [REPO, "sha"]).join(follows, [REPO, "sha"], "left")
            .select(REPO, "sha", alone, "up", F.col("sha").alias("top")),
            "walked-again",
        )
        rest = materialise(paths.join(trees, [REPO, "top"], "left_anti"), "walked")
        ends = rest.join(again.select(REPO, F.col("up").alias("sha")).distinct(), [REPO, "sha"], "left_semi")
        none = F.lit(None).cast("string").alias("up")
        walked = _along_the_forest(again.unionByName(ends.select(REPO, "sha", "path", none, "top")))
        fresh = materialise(walked.join(again.select(REPO, "sha"), [REPO, "sha"], "left_semi"), "walked-fresh")
        paths = rest.unionByName(fresh)


def _along_the_forest(nodes: DataFrame) -> DataFrame:
    """(repo_id, sha, path, top) from (repo_id, sha, path, up, top); *top* becomes the root's.

    Each round covers twice the distance; a commit that has reached its root only serves others from then on.
    """
    reach = materialise(nodes, "waits")
    while reach.where("up is not null").limit(1).count() > 0:
        above = reach.select(
            REPO, F.col("sha").alias("up"), F.col("path").alias("_above"), F.col("up").alias("_next"), F.col("top").alias("_top")
        )
        whole = F.concat(F.filter("_above", lambda x: x > F.col("path")[0]), "path")
        onward = reach.where("up is not null").join(above, [REPO, "up"], "left").select(
            REPO, "sha", whole.alias("path"), F.col("_next").alias("up"), F.col("_top").alias("top")
        )
        reach = materialise(reach.where("up is null").unionByName(onward), "waits")
    return reach.select(REPO, "sha", "path", "top")


# ------------------------------------------------------------------ events


def change_events(commits: DataFrame, files: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """One row per file change, with its commit's walk key and time."""
    keys = walk_keys(commits, parents)
    timed = commits.select(REPO, "sha", "committed_epoch", "committed_at").join(keys, [REPO, "sha"])
    return files.join(timed.withColumnRenamed("sha", "commit_sha"), [REPO, "commit_sha"])


def sequence_events(events: DataFrame, *, ranges: int | None = None) -> Sequence:
    return ordered(events, [REPO, "walk_key", "path"], ranges=ranges)


def lifecycle_events(sequence: Sequence, *, renames: bool = True) -> Sequence:
    """Add ``life_id``: the position of the event that started the file's life.

    An A or R event opens a segment of its path; so does the first event of a
    path nobody held, unless it is a deletion, which then is a life by itself.
    A segment opened by a rename continues the segment that last held the old
    path. Lives are the roots of that forest.

    ``renames=False`` states that the input holds no R event.
    """
    frame = sequence.frame
    letter = F.col("change_type")
    base = frame.select(
        "*",
        F.col("path").alias("_at"),
        F.lit(1).alias("_turn"),
        F.when(letter.isin(CREATED, RENAMED), F.col(SEQ)).alias("_opens"),
        F.when(letter != DELETED, F.col(SEQ)).alias("_held"),
    )
    if renames:
        # A rename also asks who held the old path just before it.
        asks = frame.where((letter == RENAMED) & F.col("old_path").isNotNull()).select(
            REPO, SEQ, CHUNK, F.col("old_path").alias("_at"), F.lit(0).alias("_turn")
        )
        base = base.unionByName(asks, allowMissingColumns=True)
    at = "_at" if renames else "path"
    folded = running(
        sequence.of(base),
        [REPO, at],
        [
            Running("_opened", "last", F.col("_opens")),
            Running("_first", "min", F.col("_held")),
        ],
        order=[SEQ, "_turn"],
    ).withColumn("_segment", F.coalesce("_opened", "_first"))
    if not renames:
        lives = folded.withColumn("life_id", F.coalesce("_segment", SEQ))
        # A life stays on one path, so its rows are placed already, and no larger than the path's.
        narrow = () if crowded(sequence, [REPO, "path"]) else ("life_id",)
        told = lives.select(*frame.columns, "life_id")
        return replace(sequence, frame=told, decided={"life_id": "path"}, narrow=narrow)

    folded = materialise(folded.select(*frame.columns, "_turn", "_segment"), "segments")
    roots = forest_roots(
        folded.where("_turn = 0 and _segment is not null").select(
            F.col(SEQ).alias("child"), F.col("_segment").alias("parent")
        )
    )
    lives = (
        folded.where("_turn = 1")
        .withColumn("_segment", F.coalesce("_segment", SEQ))
        .join(roots.withColumnRenamed("child", "_segment"), "_segment", "left")
        .withColumn("life_id", F.coalesce("root", "_segment"))
    )
    return sequence.of(lives.select(*frame.columns, "life_id"))


def _doubled(reach: DataFrame) -> DataFrame:
    above = reach.select(F.col("child").alias("parent"), F.col("parent").alias("_up"))
    return reach.join(above, "parent", "left").select(
        "child", F.coalesce("_up", "parent").alias("parent"), F.col("_up").isNotNull().alias("_moved")
    )


def forest_roots(edges: DataFrame) -> DataFrame:
    """(child, parent) → (child, root). Each round covers four times the distance."""
    reach = materialise(edges, "reach")
    while True:
        stepped = materialise(_doubled(_doubled(reach).drop("_moved")), "reach")
        reach = stepped.select("child", "parent")
        if stepped.where("_moved").limit(1).count() == 0:
            return reach.withColumnRenamed("parent", "root")


# ------------------------------------------------------------------ statistics


def content_changed() -> Column:
    """M always changes content; R only where lines moved with it."""
    moved = F.coalesce("added_lines", F.lit(0)) + F.coalesce("deleted_lines", F.lit(0))
    return (F.col("change_type") == MODIFIED) | ((F.col("change_type") == RENAMED) & (moved > 0))


def is_binary() -> Column:
    return F.col("added_lines").isNull() & F.col("deleted_lines").isNull()


def file_statistics(events: DataFrame) -> DataFrame:
    """One row per life. Every aggregate combines before the shuffle.

    Events that carry ``committed_at`` also give the moments as text.
    """
    changed = content_changed()
    at = F.col(SEQ)
    stamps = {"epoch": "committed_epoch", "sha": "commit_sha"}
    if "committed_at" in events.columns:
        stamps["at"] = "committed_at"
    stamp = F.struct(*stamps.values())
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")

    def moment(name: str, held: str, only: Column | None = None) -> list[Column]:
        values = {k: F.col(f"{held}.{c}") for k, c in stamps.items()}
        return [(v if only is None else F.when(only, v)).alias(f"{name}_{k}") for k, v in values.items()]

    deleted = F.col("_last.change_type") == DELETED
    return (
        events.groupBy(REPO, "life_id")
        .agg(
            F.min_by(stamp, at).alias("_first"),
            F.max_by(F.struct(*stamps.values(), "change_type", "path"), at).alias("_last"),
            F.max_by(stamp, F.when(changed, at)).alias("_edit"),
            F.count(F.lit(1)).alias("commits"),
            n(changed).alias("modifications"),
            n(F.col("change_type") == RENAMED).alias("renames"),
            F.sum(F.coalesce("added_lines", F.lit(0))).alias("additions"),
            F.sum(F.coalesce("deleted_lines", F.lit(0))).alias("deletions"),
            n(is_binary()).alias("binary_changes"),
        )
        .select(
            REPO,
            "life_id",
            F.col("_last.path").alias("current_path"),
            *moment("created", "_first"),
            *moment("last_modified", "_edit"),
            "commits",
            "modifications",
            "renames",
            "additions",
            "deletions",
            (F.col("additions") - F.col("deletions")).alias("net_change"),
            (F.col("additions") + F.col("deletions")).alias("churn"),
            "binary_changes",
            deleted.alias("is_deleted"),
            *moment("deleted", "_last", deleted),
        )
    )


def path_history(lives: Sequence) -> DataFrame:
    """The names of each life in order, repeated runs collapsed: one row per name."""
    named = running(
        lives, [REPO, "life_id"], [Running("_was", "last", F.col("path"), before=True)]
    )
    return named.where("_was is null or _was <> path").select(REPO, "life_id", SEQ, "path")


def lives_of_path(events: DataFrame, path: str) -> DataFrame:
    """Every life that ever carried *path*; a deletion's own name counts too."""
    return events.where(F.col("path") == path).select(REPO, "life_id").distinct()


def hotspots(statistics: DataFrame, *, include_deleted: bool = False, limit: int | None = 20) -> DataFrame:
    kept = statistics if include_deleted else statistics.where(~F.col("is_deleted"))
    ranked = kept.orderBy(F.desc("commits"), "current_path", "life_id")
    return ranked if limit is None else ranked.limit(limit)


def inventory(statistics: DataFrame, *, limit: int | None = None) -> DataFrame:
    state = F.when(F.col("is_deleted"), "deleted").otherwise("alive")
    listed = statistics.withColumn("state", state).orderBy("current_path", "life_id")
    return listed if limit is None else listed.limit(limit)
