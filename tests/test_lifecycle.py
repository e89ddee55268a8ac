import random

import pytest
from pyspark.sql import functions as F

from gitloom.operators import lifecycle as lc
from gitloom.operators.sequence import CHUNK, SEQ, ordered, positioned
from tests import walks


def _log(rng, repo, n):
    paths = [f"p{i}" for i in range(rng.randint(1, 5))]
    rows = []
    for i in range(n):
        letter = rng.choice("AMMRDTC")
        path = rng.choice(paths)
        old = rng.choice(paths) if letter in "RC" else None
        rows.append((repo, i, letter, path, old, rng.choice([None, 0, 3]), rng.randint(0, 2)))
    return rows


@pytest.fixture(scope="module")
def random_logs():
    rng = random.Random(7)
    return [row for r in range(60) for row in _log(rng, f"r{r:02d}", rng.randint(1, 25))]


SCHEMA = (
    "repo_id string, pos long, change_type string, path string, old_path string,"
    " added_lines long, deleted_lines long"
)


@pytest.mark.parametrize("ranges", [None, 7])
def test_lives_match_a_sequential_walk(spark, random_logs, ranges):
    frame = spark.createDataFrame(random_logs, SCHEMA)
    sequence = ordered(frame, ["repo_id", "pos"], ranges=ranges)
    # Several ranges without asking for them: the plan of large histories.
    assert sequence.frame.select(CHUNK).distinct().count() > 1
    got = lc.lifecycle_events(sequence).frame.collect()
    first = {r[SEQ]: (r["repo_id"], r["pos"]) for r in got}
    found = {(r["repo_id"], r["pos"]): first[r["life_id"]][1] for r in got}
    want = {}
    for repo in {r[0] for r in random_logs}:
        log = [(r[1], r[2], r[3], r[4]) for r in random_logs if r[0] == repo]
        want.update({(repo, k): v for k, v in walks.lives(log).items()})
    assert found == want


def test_one_hot_path_spans_ranges(spark):
    rows = [("r", i, "A" if i % 50 == 0 else "M", "hot", None, 1, 1) for i in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    lives = lc.lifecycle_events(ordered(frame, ["repo_id", "pos"]), renames=False)
    counts = lives.frame.groupBy("life_id").count().collect()
    assert sorted(r["count"] for r in counts) == [50] * 8


@pytest.mark.parametrize("chunk", [8, 1 << 20])
def test_numbered_rows_keep_their_positions(spark, chunk):
    log = _log(random.Random(3), "r", 60)
    frame = spark.createDataFrame(log, SCHEMA)
    sequence = positioned(frame, "pos", chunk_rows=chunk)
    assert sequence.frame.select(CHUNK).distinct().count() == (8 if chunk == 8 else 1)
    got = {r["pos"]: r["life_id"] for r in lc.lifecycle_events(sequence).frame.collect()}
    assert got == walks.lives([(r[1], r[2], r[3], r[4]) for r in log])


@pytest.mark.parametrize("ranges", [None, 5])
def test_path_history_collapses_runs(spark, ranges):
    log = [("A", "a", None), ("M", "a", None), ("R", "b", "a"), ("R", "a", "b"), ("M", "a", None)]
    rows = [("r", i, c, p, o, 1, 1) for i, (c, p, o) in enumerate(log)]
    lives = lc.lifecycle_events(ordered(spark.createDataFrame(rows, SCHEMA), ["repo_id", "pos"], ranges=ranges))
    names = [r["path"] for r in lc.path_history(lives).orderBy(SEQ).collect()]
    assert names == ["a", "b", "a"]


def test_positions_have_no_gaps(spark):
    frame = spark.range(100).withColumn("k", F.col("id") * 3)
    rows = ordered(frame, ["k"], ranges=6).frame.orderBy("k").collect()
    assert [r[SEQ] for r in rows] == list(range(1, 101))


@pytest.mark.parametrize("skew", [False, True])
def test_commit_order_matches_the_heap(spark, skew):
    rng = random.Random(11)
    commits, parents, want = [], [], {}
    for r in range(12 if skew else 4):
        n = rng.randint(2, 14)
        shas = [f"{rng.randrange(16**6):06x}" for _ in range(n)]
        shas = list(dict.fromkeys(shas))
        epochs, links = {}, {}
        for i, sha in enumerate(shas):
            links[sha] = rng.sample(shas[:i], min(i, rng.randint(0, 2)))
            floor = max([epochs[p] for p in links[sha]], default=0)
            epochs[sha] = rng.randint(0, 6) if skew else floor + 1
        want[f"r{r}"] = walks.commit_order(epochs, links)
        commits += [(f"r{r}", s, epochs[s]) for s in shas]
        parents += [(f"r{r}", s, p) for s in shas for p in links[s] + ["unknown"]]
    c = spark.createDataFrame(commits, "repo_id string, sha string, committed_epoch long")
    p = spark.createDataFrame(parents, "repo_id string, commit_sha string, parent_sha string")
    got = lc.walk_keys(c, p).orderBy("repo_id", "walk_key").collect()
    found = {}
    for row in got:
        found.setdefault(row["repo_id"], []).append(row["sha"])
    assert found == want


LIFECYCLE_FIXTURE = [
    [("A", "app.py", None), ("A", "heavy.py", None), ("A", "kept.py", None), ("A", "plain.py", None)],
    [("R", "src/app.py", "app.py")],
    [("M", "plain.py", None), ("R", "src/core/app.py", "src/app.py")],
    [("D", "src/core/app.py", None)],
    [("A", "app.py", None)],
    [("R", "reused.py", "kept.py")],
    [("A", "kept.py", None)],
    [("D", "heavy.py", None), ("A", "renamed.py", None)],
]


def test_documented_lifecycle_history(spark):
    rows = [
        ("r", i, letter, path, old, 1, 0)
        for i, change in enumerate(LIFECYCLE_FIXTURE)
        for letter, path, old in change
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "pos as committed_epoch", "cast(pos as string) as commit_sha"
    )
    lives = lc.lifecycle_events(ordered(frame, ["repo_id", "pos", "path"]))
    stats = lc.file_statistics(lives.frame).orderBy("life_id").collect()
    assert [(r["current_path"], r["commits"], r["renames"], r["is_deleted"]) for r in stats] == [
        ("src/core/app.py", 4, 2, True),
        ("heavy.py", 2, 0, True),
        ("reused.py", 2, 1, False),
        ("plain.py", 2, 0, False),
        ("app.py", 1, 0, False),
        ("kept.py", 1, 0, False),
        ("renamed.py", 1, 0, False),
    ]
    assert lc.lives_of_path(lives.frame, "app.py").count() == 2
    assert lc.lives_of_path(lives.frame, "kept.py").count() == 2


def test_links_are_read_once(spark, monkeypatch):
    written, write = [], lc.materialise

    def counted(frame, name):
        stored = write(frame, name)
        written.append((name, stored.count()))
        return stored

    monkeypatch.setattr(lc, "materialise", counted)
    # Ten commits in a line, the first one's clock far ahead: every one waits for it.
    commits = spark.createDataFrame(
        [("r", f"c{n:02d}", 1000 if n == 0 else n) for n in range(10)], "repo_id string, sha string, committed_epoch long"
    )
    parents = spark.createDataFrame(
        [("r", f"c{n:02d}", f"c{n - 1:02d}") for n in range(1, 10)], "repo_id string, commit_sha string, parent_sha string"
    )
    found = lc.walk_keys(commits, parents).collect()
    assert sorted(found, key=lambda r: r["walk_key"]) == sorted(found, key=lambda r: r["sha"])
    assert [n for name, n in written if name == "walk-edges"] == [9]
