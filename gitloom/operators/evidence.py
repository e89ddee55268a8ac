"""What a unit of history holds: a commit, a revision range, or many ranges at once.

A unit is named by (repo_id, unit). ``members`` says which commits it holds, with
their ``ordinal``, oldest first. Every operator answers for all units together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gitloom.operators.lifecycle import DELETED, REPO, RENAMED, SEQ, content_changed, is_binary
from gitloom.operators.sequence import Running, Sequence, running
from gitloom.session import materialise

UNIT = [REPO, "unit"]
LIFE = [REPO, "life_id"]

# How much of each list a bounded view holds.
FILE_CHANGES = 20
RANGES_PER_FILE = 5
DEFINITIONS = 20
ABSENCES = 20
COMMITS = 25
HISTORY_WINDOW = 2
HISTORY_COMMITS = 5
CO_CHANGE_FILES = 5
CO_CHANGE_PARTNERS = 5
MESSAGE_CHARACTERS = 4000

# Why a unit's evidence does not hold something.
MERGE_NO_DIFF = "merge_no_diff"
BINARY_NO_TEXT = "binary_no_text"
PARSE_FAILED = "parse_failed"
NO_VERSION_STORED = "no_version_stored"
NOT_IN_THIS_COMMIT = "not_in_this_commit"
NOT_STORED = "no version was stored for this commit"
NOT_IN_TREE = "the file was not in this commit"
NO_ROW = "the analysis holds no row for "
NO_MERGE_DIFF = "git prints no diff for the merge "
NOT_ANALYZED = "not_analyzed"
GONE_WITHIN_RANGE = "gone_within_range"
NET_UNCHANGED = "net_unchanged"
WHY = {
    GONE_WITHIN_RANGE: "created inside the range and deleted before the tip",
    NET_UNCHANGED: "touched inside the range, and the endpoints hold one content",
    BINARY_NO_TEXT: "the endpoint blobs are binary, so git prints no diff text",
}

def _n(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def _lines(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast("long"))


# ------------------------------------------------------------------ one commit's changes


def change_states(files: DataFrame, merges: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each change with ``diff_state``: what is known about where it landed.

    *ranges* has a row for every (commit, path) git printed a section for.
    """
    merged = merges.select(REPO, "commit_sha", F.lit(True).alias("_merge"))
    seen = (
        ranges.groupBy(REPO, "commit_sha", "path")
        .agg(F.count("start").alias("ranges"))
        .withColumn("_seen", F.lit(True))
    )
    state = (
        F.when(F.col("_merge"), "no_diff_recorded")
        .when(F.col("change_type") == DELETED, "deleted_file")
        .when(is_binary(), "binary")
        .when(F.col("_seen"), "ranges")
        .otherwise("no_ranges_recorded")
    )
    counted = F.when(F.col("diff_state") == "ranges", F.col("ranges")).otherwise(F.lit(0).cast("long"))
    return (
        files.join(merged, [REPO, "commit_sha"], "left")
        .join(seen, [REPO, "commit_sha", "path"], "left")
        .withColumn("diff_state", state)
        .withColumn("ranges", counted)
        .drop("_merge", "_seen")
    )


# ------------------------------------------------------------------ ranges of commits


def header(members: DataFrame, commits: DataFrame, merges: DataFrame) -> DataFrame:
    """Per unit: commits, merges, its authors by name and address, and when its first and last were authored."""
    rows = members.join(commits.withColumnRenamed("sha", "commit_sha"), [REPO, "commit_sha"]).join(
        merges.select(REPO, "commit_sha", F.lit(True).alias("_merge")), [REPO, "commit_sha"], "left"
    )
    return rows.groupBy(*UNIT).agg(
        F.count(F.lit(1)).alias("commits"),
        _n(F.col("_merge")).alias("merges"),
        F.array_sort(
            F.collect_set(F.concat("author_name", F.lit(" <"), "author_email", F.lit(">")))
        ).alias("authors"),
        F.min_by("authored_at", "ordinal").alias("first_authored_at"),
        F.max_by("authored_at", "ordinal").alias("last_authored_at"),
    )


def occurrences(members: DataFrame, files: DataFrame) -> DataFrame:
    """Every touch of a path inside a unit, in the unit's order."""
    return files.join(members, [REPO, "commit_sha"])


def path_changes(touches: DataFrame) -> DataFrame:
    """One row per (unit, path): the sum of its touches, first and last."""
    return touches.groupBy(*UNIT, "path").agg(
        F.count(F.lit(1)).alias("touches"),
        F.sum(_lines("added_lines")).alias("added_lines"),
        F.sum(_lines("deleted_lines")).alias("deleted_lines"),
        F.max(is_binary()).alias("is_binary"),
        F.min_by("change_type", "ordinal").alias("first_change"),
        F.max_by("change_type", "ordinal").alias("last_change"),
    )


def with_net(changes: DataFrame, net: DataFrame, texts: DataFrame) -> DataFrame:
    """Add what the two endpoints say: net status, and binary where no text came out."""
    shown = texts.select(*UNIT, "path", F.lit(True).alias("_text"))
    differs = F.col("net_status").isNotNull() & (F.col("old_blob") != F.col("new_blob"))
    return (
        changes.join(net.select(*UNIT, "path", "net_status", "old_blob", "new_blob"), [*UNIT, "path"], "left")
        .join(shown, [*UNIT, "path"], "left")
        .withColumn("has_text", F.col("_text").isNotNull())
        .withColumn("is_binary", F.col("is_binary") | (differs & F.col("_text").isNull()))
        .drop("_text")
    )


def _absent(frame: DataFrame, kind: Column | str, path: Column | None, detail: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    path = F.lit(None).cast("string") if path is None else path
    return frame.select(*UNIT, kind.alias("kind"), path.alias("path"), detail.alias("detail"))


def commit_absences(members: DataFrame, merges: DataFrame, files: DataFrame, steps: DataFrame) -> DataFrame:
    """What could not be read at each unit's commits: merges, binaries, unread versions."""
    merged = members.join(merges.select(REPO, "commit_sha"), [REPO, "commit_sha"], "left_semi")
    binary = files.where(is_binary()).join(members, [REPO, "commit_sha"])
    return reduce(
        DataFrame.unionByName,
        [
            _absent(merged, MERGE_NO_DIFF, None, F.lit("git prints no diff for a merge commit")),
            _absent(
                binary, BINARY_NO_TEXT, F.col("path"), F.lit("the file is binary, so git prints no diff text")
            ),
            unread_versions(members, steps),
        ],
    )


def _why(kind: Column) -> Column:
    return F.create_map(*[F.lit(v) for pair in WHY.items() for v in pair])[kind]


def unread_versions(members: DataFrame, steps: DataFrame) -> DataFrame:
    """Python versions inside a unit that nobody could read, the file's end included."""
    unread = steps.where((F.col("state") != "read") & F.col("path").endswith(".py"))
    kind = (
        F.when(F.col("state") == "not_stored", NO_VERSION_STORED)
        .when(F.col("state") == "parse_failed", PARSE_FAILED)
        .otherwise(NOT_IN_THIS_COMMIT)
    )
    detail = F.coalesce("parse_error", F.when(F.col("state") == "not_stored", NOT_STORED).otherwise(NOT_IN_TREE))
    return _absent(unread.join(members, [REPO, "commit_sha"]), kind, F.col("path"), detail)


def range_absences(
    members: DataFrame, stored: DataFrame, merges: DataFrame, steps: DataFrame, changes: DataFrame
) -> DataFrame:
    """The same for ranges, with what the endpoints leave out. *changes*: from with_net."""
    known = stored.select(REPO, F.col("sha").alias("commit_sha")).withColumn("_stored", F.lit(True))
    placed = members.join(known, [REPO, "commit_sha"], "left").join(
        merges.select(REPO, "commit_sha", F.lit(True).alias("_merge")), [REPO, "commit_sha"], "left"
    )
    missing = placed.where("_stored is null")
    merged = placed.where("_stored and _merge")
    born = F.col("first_change").isin("A", "R", "C")
    kind = (
        F.when(F.col("net_status").isNull() & born & (F.col("last_change") == DELETED), GONE_WITHIN_RANGE)
        .when(F.col("net_status").isNull() | (F.col("old_blob") == F.col("new_blob")), NET_UNCHANGED)
        .when(~F.col("has_text"), BINARY_NO_TEXT)
    )
    paths = changes.withColumn("_kind", kind).where("_kind is not null")
    return reduce(
        DataFrame.unionByName,
        [
            _absent(missing, NOT_ANALYZED, None, F.concat(F.lit(NO_ROW), "commit_sha")),
            _absent(merged, MERGE_NO_DIFF, None, F.concat(F.lit(NO_MERGE_DIFF), "commit_sha")),
            unread_versions(members, steps),
            _absent(paths, F.col("_kind"), F.col("path"), _why(F.col("_kind"))),
        ],
    )


# ------------------------------------------------------------------ lives seen from a unit


def running_statistics(lives: Sequence) -> DataFrame:
    """Each event with its life's totals up to and including it."""
    changed, renamed = content_changed(), F.col("change_type") == RENAMED
    told = running(
        lives,
        LIFE,
        [
            Running("commits", "count", F.lit(1)),
            Running("modifications", "count", F.when(changed, 1)),
            Running("renames", "count", F.when(renamed, 1)),
            Running("additions", "sum", _lines("added_lines")),
            Running("deletions", "sum", _lines("deleted_lines")),
            Running("last_modified_sha", "last", F.when(changed, F.col("commit_sha"))),
        ],
    )
    return materialise(told, "totals")


def event_numbers(lives: Sequence) -> DataFrame:
    """Each event with ``commits``, its number in its life: all that a look back needs."""
    return materialise(running(lives, LIFE, [Running("commits", "count", F.lit(1))]), "numbers")


def touched_lives(numbers: DataFrame, members: DataFrame) -> DataFrame:
    """Each life a unit touches: the path it leaves it under and where it first touched it."""
    return (
        numbers.join(members, [REPO, "commit_sha"])
        .groupBy(*UNIT, "life_id")
        .agg(F.max_by("path", SEQ).alias("path"), F.min("commits").alias("first_position"))
    )


def lives_as_left(totals: DataFrame, members: DataFrame) -> DataFrame:
    """Each touched life as its unit leaves it: cut at its last event inside the unit.

    Also where the unit first touched it (``first_position``, 1-based in the life).
    """
    inside = totals.select(*LIFE, "commit_sha", SEQ, "commits").join(members.select(*UNIT, "commit_sha"), [REPO, "commit_sha"])
    # Two numbers per row are grouped; the last event itself is looked up by its position.
    last = inside.groupBy(*UNIT, "life_id").agg(F.max(SEQ).alias(SEQ), F.min("commits").alias("first_position"))
    return last.join(totals, [*LIFE, SEQ]).select(
        *UNIT, "life_id", "path", "commits", "modifications", "renames", "additions", "deletions", "last_modified_sha",
        (F.col("change_type") == DELETED).alias("is_deleted"),
        "first_position",
    )


# What one stretch of a life holds.
STRETCH = 1 << 12


def earlier_commits(totals: DataFrame, left: DataFrame, window: int = HISTORY_COMMITS, many: bool = False) -> DataFrame:
    """The last events of each touched life before its unit began, and how many there were.

    The wanted positions are written out and looked up, so no life is walked. *many*: about as many
    are asked as there are events; then stretches of each life are walked instead.
    """
    total = F.col("first_position") - 1
    if many:
        return _walked_back(totals, left.withColumn("total", total), window)
    wanted = left.where("first_position > 1").select(
        *UNIT,
        "life_id",
        total.alias("total"),
        F.explode(F.sequence(F.greatest(total - window + 1, F.lit(1)), total)).alias("commits"),
    )
    rows = totals.select(*LIFE, "commits", "commit_sha", "change_type", "added_lines", "deleted_lines")
    return wanted.join(rows, [*LIFE, "commits"]).withColumnRenamed("commits", "position")


def _walked_back(totals: DataFrame, left: DataFrame, window: int) -> DataFrame:
    """The same, by a window over stretches of a life. The end of a stretch is in the next one too."""
    shown = ["commit_sha", "change_type", "added_lines", "deleted_lines"]
    stretch = F.floor(F.col("_at") / STRETCH)
    late = F.pmod("_at", F.lit(STRETCH)) > STRETCH - window
    event = F.struct(F.col("commits").alias("position"), *shown)
    events = (
        totals.where("repo_id is not null and life_id is not null")
        .select(*LIFE, F.lit(None).cast("string").alias("unit"), F.col("commits").alias("_at"), event.alias("_e"))
        .withColumn("_stretch", F.explode(F.when(late, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))))
    )
    asked = left.where("first_position > 1").select(
        *UNIT, "life_id", F.col("total").alias("_at"), F.lit(None).cast(events.schema["_e"].dataType).alias("_e"), stretch.alias("_stretch")
    )
    rows = events.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)))
    back = Window.partitionBy(*LIFE, "_stretch").orderBy("_at").rangeBetween(1 - window, Window.currentRow)
    return (
        rows.withColumn("_held", F.collect_list("_e").over(back))
        .where("_asked")
        .select(*UNIT, "life_id", F.col("_at").alias("total"), F.explode("_held").alias("_e"))
        .select(*UNIT, "life_id", "total", "_e.*")
    )


def bounds(left: DataFrame, lifetimes: DataFrame, window: int = HISTORY_COMMITS) -> DataFrame:
    """Per unit: co-change files and earlier commits the caps leave out.

    *lifetimes* gives each life's whole number of events; one is too few to pair.
    """
    whole = lifetimes.select(*LIFE, F.col("commits").alias("_whole"))
    over = F.greatest(F.col("first_position") - 1 - window, F.lit(0))
    return (
        left.join(whole, LIFE)
        .groupBy(*UNIT)
        .agg(_n(F.col("_whole") >= 2).alias("_ranked"), F.sum(over).alias("history_commits_omitted"))
        .select(
            *UNIT,
            F.greatest(F.col("_ranked") - CO_CHANGE_FILES, F.lit(0)).alias("co_change_files_omitted"),
            "history_commits_omitted",
        )
    )


def definition_presence(events: DataFrame, members: DataFrame, steps: DataFrame) -> DataFrame:
    """Per unit and definition: whether it stood at the base and at the tip.

    A tip version that did not parse leaves the tip unknown.
    """
    key = [*UNIT, "path", "qualname", "occurrence"]
    inside = events.join(members, [REPO, "commit_sha"])
    tips = (
        steps.join(members, [REPO, "commit_sha"])
        .where("state in ('read', 'parse_failed')")
        .groupBy(*UNIT, "path")
        .agg(F.max_by("state", "ordinal").alias("_tip"))
    )
    placed = F.when(F.col("lineno").isNotNull(), F.col("ordinal"))
    size = F.greatest(F.coalesce("end_lineno", "lineno") - F.col("lineno") + 1, F.lit(0))
    return (
        # The tip is looked up first, by the columns that lead the key, so that rows are grouped where that put them.
        inside.join(tips, [*UNIT, "path"], "left")
        .groupBy(*key)
        .agg(
            F.max("_tip").alias("_tip"),
            F.min("kind").alias("kind"),
            F.count(F.lit(1)).alias("events"),
            F.min_by("change", F.struct("ordinal", "kind")).alias("_first"),
            F.max_by("change", F.struct("ordinal", "kind")).alias("_last"),
            F.coalesce(F.max_by(size, placed), F.lit(0)).cast("long").alias("size"),
        )
        .select(
            *key,
            "kind",
            "events",
            "size",
            F.when(F.col("_first") == "created", "absent").otherwise("present").alias("presence_base"),
            F.when(F.col("_tip") == "parse_failed", "unreadable")
            .when(F.col("_last") == "deleted", "absent")
            .otherwise("present")
            .alias("presence_tip"),
        )
    )


# ------------------------------------------------------------------ bounded views


def largest(rows: DataFrame, size: Column, names: list[str], cap: int) -> DataFrame:
    """The *cap* largest rows of each unit. Ranks over the cap are cut before the shuffle."""
    window = Window.partitionBy(*UNIT).orderBy(F.desc("_size"), *names)
    return (
        rows.withColumn("_size", size)
        .withColumn("_rank", F.row_number().over(window))
        .where(F.col("_rank") <= cap)
        .drop("_rank", "_size")
    )


def first_rows(rows: DataFrame, names: list[Column | str], cap: int) -> DataFrame:
    window = Window.partitionBy(*UNIT).orderBy(*names)
    return rows.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= cap).drop("_rank")


def kept_commits(members: DataFrame, touches: DataFrame, cap: int = COMMITS) -> DataFrame:
    """The commits that moved the most lines, in the unit's own order."""
    moved = touches.groupBy(*UNIT, "commit_sha").agg(
        F.sum(_lines("added_lines") + _lines("deleted_lines")).alias("moved")
    )
    sized = members.join(moved, [*UNIT, "commit_sha"], "left").withColumn("moved", _lines("moved"))
    return largest(sized, F.col("moved"), ["commit_sha"], cap).orderBy(*UNIT, "ordinal")


def kept_changes(changes: DataFrame, cap: int = FILE_CHANGES) -> DataFrame:
    return largest(changes, F.col("added_lines") + F.col("deleted_lines"), ["path"], cap)


def kept_definitions(definitions: DataFrame, cap: int = DEFINITIONS) -> DataFrame:
    return largest(definitions, F.col("size"), ["path", "qualname", "occurrence"], cap)


def kept_absences(absences: DataFrame, cap: int = ABSENCES) -> DataFrame:
    return first_rows(absences, [F.coalesce("path", F.lit("")), "kind", "detail"], cap)


def kept_lives(left: DataFrame, names: DataFrame, changes: DataFrame, cap: int = FILE_CHANGES) -> DataFrame:
    """Lives that ever carried the name of a kept change. *names*: every name a life had."""
    held = left.select(*UNIT, "life_id").join(names.select(*LIFE, "path"), LIFE)
    return lives_of_changes(left, held, changes, cap)


def lives_of_changes(lives: DataFrame, names: DataFrame, changes: DataFrame, cap: int = FILE_CHANGES) -> DataFrame:
    """The same where *names* says what each life of a unit was called."""
    reached = (
        names.join(changes.select(*UNIT, "path"), [*UNIT, "path"], "left_semi").select(*UNIT, "life_id").distinct()
    )
    return first_rows(lives.join(reached, [*UNIT, "life_id"], "left_semi"), ["life_id"], cap)


def cut_messages(commits: DataFrame, cap: int = MESSAGE_CHARACTERS) -> DataFrame:
    length = F.length("message")
    return commits.withColumn("characters_omitted", F.greatest(length - cap, F.lit(0))).withColumn(
        "message", F.substring("message", 1, cap)
    )
