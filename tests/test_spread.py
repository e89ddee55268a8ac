"""What a query costs besides its rows: results per key and range, patches nobody asked for."""

import pytest
from pyspark.sql import functions as F

from gitloom.operators import evidence as ev
from gitloom.operators import lifecycle as lc
from gitloom.operators import memory as m
from gitloom.operators import sequence as sq
from gitloom.sources import adapters as a

COMMITS = "repo_id string, sha string, committed_epoch long"
CITED = "repo_id string, memory_id string, kind string, ref string, position int"
EVENTS = (
    "repo_id string, commit_sha string, life_id long, path string, old_path string, change_type string, "
    "added_lines long, deleted_lines long, committed_epoch long, seq long"
)


def _rows(n, keys):
    return [("r", f"f{i % keys if i % 3 else 0}", i, "A" if i < keys else "DMM"[i % 3], i % 4, 1) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(
        rows, "repo_id string, path string, n int, change_type string, added_lines long, deleted_lines long"
    ).withColumn("commit_sha", F.lpad("n", 4, "0"))


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_no_result_per_key_and_range_where_no_key_is_crowded(spark):
    walk = sq.ordered(_frame(spark, _rows(60, 7)), ["n"], ranges=6)
    told = sq.running(walk, ["repo_id", "path"], [sq.Running("_n", "count", F.lit(1))])
    plan = _plan(told)
    assert "_w__n" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_crowded_keys_and_others_fold_alike(spark, monkeypatch, most):
    rows = _rows(60, 7) + [("r", None, 60, "M", 1, 1)]
    monkeypatch.setattr(sq, "CROWDED", most)
    lives = lc.lifecycle_events(sq.ordered(_frame(spark, rows), ["n"], ranges=6), renames=False)
    got = {r["n"]: r for r in ev.running_statistics(lives).collect()}
    assert sorted(got) == [*range(60)]
    held, seen = {}, {}
    for _, path, i, letter, added, deleted in rows[:-1]:
        if letter == "A" or path not in held and letter != "D":
            held[path] = i + 1
        life = held.get(path, i + 1)
        s = seen.setdefault(life, [0, 0, 0, None])
        s[0] += 1
        s[1] += letter == "M"
        s[2] += added
        s[3] = f"{i:04d}" if letter == "M" else s[3]
        assert got[i]["life_id"] == life
        assert [got[i][c] for c in ("commits", "modifications", "additions", "last_modified_sha")] == s


def test_a_life_is_placed_by_its_path(spark):
    lives = lc.lifecycle_events(sq.ordered(_frame(spark, _rows(60, 7)), ["n"]), renames=False)
    told = sq.running(lives, ["repo_id", "life_id"], [sq.Running("_n", "count", F.lit(1))])
    assert told._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_patches_of_commits_nobody_cites_are_not_read(spark):
    # A commit may stand twice; what cites it still stands once.
    commits = spark.createDataFrame([("r", f"{i:08x}", i) for i in [*range(20), 3, 5]], COMMITS)
    cited = spark.createDataFrame(
        [
            ("r", "m1", "commit", "00000003", 2), ("r", "m1", "commit", "00000004", 1), ("r", "m1", "range", "x:2-3", 3),
            ("r", "m2", "range", "x:2-3", 1), ("r", "m3", "commit", "00000005", 1), (None, "m4", "commit", "00000005", 1),
            ("r", None, "commit", "00000005", 1), ("r", "m3", "commit", "0000000", 2), ("r", "m3", "commit", "000", 3),
            ("r", "m3", "file", "./x", 4), ("r", "m3", "file", "y", 5), ("r", "m3", "definition", "f", 6),
            ("r", None, "file", "x", 6), ("r", "m3", "absence", "merge_no_diff", 7), ("r", "m3", "absence", None, 7),
            ("r", "m3", "cochange", "x -> z", 8), ("r", "m3", "cochange", "x -> x", 9), ("r", "m3", "cochange", "x", 9),
        ],
        CITED,
    )
    events = spark.createDataFrame(
        [("r", f"{i:08x}", life, path, None, "M", 1, 1, i, 2 * i + life) for i in range(3) for life, path in ((1, "x"), (2, "z"))], EVENTS
    )
    names = spark.createDataFrame([("r", "x", "f")], "repo_id string, path string, qualname string")
    asked = []

    def ranges(of):
        asked.extend(tuple(r) for r in of.collect())
        return spark.createDataFrame([("r", "00000004", "x", 2, 3)], "repo_id string, commit_sha string, path string, start int, end int")

    found = m.resolve_citations(cited, commits, events, names, ranges, lc.file_statistics(events))
    assert found.columns == [*cited.columns, "resolution"]
    got = found.collect()
    assert len(got) == cited.count()
    assert asked == [("r", "00000004")]
    held = {(r["memory_id"], r["kind"], r["ref"]) for r in got if r["resolution"] == "resolved"}
    assert held == {
        ("m1", "commit", "00000003"), ("m1", "commit", "00000004"), ("m1", "range", "x:2-3"), ("m3", "commit", "00000005"),
        ("m3", "commit", "0000000"), ("m3", "file", "./x"), ("m3", "definition", "f"), ("m3", "absence", "merge_no_diff"),
        ("m3", "cochange", "x -> z"),
    }


def test_patches_of_asked_commits(spark):
    sf = "/root/testdata/sf0.001"
    of = a.commits(spark, sf).orderBy("sha").limit(5).select("repo_id", F.col("sha").alias("commit_sha"))
    whole = a.patch_ranges(spark, sf)
    want = sorted(map(tuple, whole.join(of, ["repo_id", "commit_sha"], "left_semi").select(*whole.columns).collect()))
    assert want and sorted(map(tuple, a.patch_ranges(spark, sf, of).collect())) == want


def test_file_changes_are_grouped_without_sorting(spark):
    plan = a.commit_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "min(l_returnflag" not in plan
