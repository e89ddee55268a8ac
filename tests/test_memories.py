import json

import pytest
from pyspark.sql import functions as F

from gitloom.memories import MemoryBook, MemoryError_
from gitloom.operators import memory as m
from gitloom.sources.store import Store


@pytest.fixture()
def book(spark, tmp_path):
    return MemoryBook(spark, Store(spark, str(tmp_path / "store")), "/repo")


def test_acts_follow_the_states(book):
    first = book.admit("Never log tokens", [("file", "a.py"), ("commit", "abcdef12")], subject_kind="repository")
    second = book.supersede(first[:8], "Log hashes only", subject_kind="path", subject_path="a.py")
    rows = {r["memory_id"]: r for r in book.read().collect()}
    assert (rows[first]["state"], rows[first]["superseded_by"]) == ("superseded", second)
    with pytest.raises(MemoryError_, match="is over"):
        book.invalidate(first, "wrong")
    with pytest.raises(MemoryError_, match="reason"):
        book.invalidate(second, "  ")
    book.invalidate(second, "moved on")
    assert {r["state"] for r in book.read().collect()} == {"superseded", "invalidated"}
    cited = book.citations().orderBy("position").collect()
    assert [(r["kind"], r["ref"]) for r in cited] == [("commit", "abcdef12"), ("file", "a.py")]


@pytest.mark.parametrize(
    "statement, fields",
    [
        ("", {"subject_kind": "repository"}),
        ("x" * 4001, {"subject_kind": "repository"}),
        ("x", {"subject_kind": "path"}),
        ("x", {"subject_kind": "repository", "since_date": "2024-02-30"}),
        ("x", {"subject_kind": "repository", "since_date": "2024-02-03", "since_commit_sha": "abcdef1"}),
    ],
)
def test_refused_acts_write_nothing(book, statement, fields):
    with pytest.raises(MemoryError_):
        book.admit(statement, **fields)
    assert book.read().count() == 0


@pytest.mark.parametrize("act", ["admit", "supersede", "import"])
def test_an_act_that_stops_half_way_leaves_nothing_to_see(spark, book, tmp_path, monkeypatch, act):
    """Statements and citations are both written when the job dies; no reader sees either."""
    first = book.admit("one", [("file", "a.py")], subject_kind="repository")
    out = str(tmp_path / "out")
    book.export(out)
    other = MemoryBook(spark, Store(spark, str(tmp_path / "other")), "/other")

    def run():
        if act == "admit":
            return book.admit("two", [("file", "b.py")], subject_kind="repository")
        if act == "supersede":
            return book.supersede(first, "two", [("file", "b.py")], subject_kind="repository")
        return other.take_in(out, "/repo")

    def dies(batch):
        raise OSError("the executor that held the driver is gone")

    with monkeypatch.context() as patch:
        patch.setattr(book.store, "_publish", dies)
        patch.setattr(other.store, "_publish", dies)
        with pytest.raises(OSError):
            run()
    held = other if act == "import" else book
    before = (0, 0) if act == "import" else (1, 1)
    assert (held.read().count(), held.citations().count()) == before
    assert all(r["state"] == "active" for r in held.read().collect())
    run()
    assert (held.read().count(), held.citations().count()) == (before[0] + 1, before[1] + 1)


STARTS = [
    ("abcdef1000000", 30),  # two commits begin like it: the newest, not the last by name
    ("ABCDEF1", 30),  # letters of either case
    ("abc", 50),  # shorter than the letters that count
    ("abcdef2", 50),
    ("0000000", None),  # no commit has it
    ("abc%", None),  # no sha
    (None, None),
]


def test_a_start_is_the_newest_commit_that_begins_like_it(spark):
    commits = [("r", "abcdef1aaa", 30), ("r", "abcdef1bbb", 20), ("r", "abcdef2ccc", 50), ("q", "abcdef1ddd", 99)]
    commits = spark.createDataFrame(commits, "repo_id string, sha string, committed_epoch long").withColumn(
        "committed_at", F.concat(F.lit("day "), "committed_epoch")
    )
    rows = [(i, "r", sha, None, None) for i, (sha, _) in enumerate(STARTS)] + [(90, "r", None, "2024-01-02", None)]
    asked = spark.createDataFrame(
        rows, "i int, repo_id string, since_commit_sha string, since_date string, ended_epoch long"
    )
    got = {r["i"]: r for r in m.in_force(asked, commits, F.lit(30), F.lit("2024-01-02T01:00:00+00:00")).collect()}
    for i, (_, epoch) in enumerate(STARTS):
        assert got[i]["since_epoch"] == epoch, STARTS[i]
        assert got[i]["since_at"] == (f"day {epoch}" if epoch else None)
        assert got[i]["in_force"] == (epoch == 30)
    assert got[90]["in_force"]
    none = m.in_force(asked.where("since_commit_sha is null"), commits, F.lit(30), F.lit("2024"))
    assert none.select("since_epoch").distinct().collect() == [(None,)]
    assert m.in_force(asked, commits.limit(0), F.lit(30), F.lit("2024")).where("since_epoch is not null").count() == 0


def test_adopt_moves_once(spark, book):
    book.admit("x", subject_kind="repository")
    moved = MemoryBook(spark, book.store, "/new")
    with pytest.raises(MemoryError_):
        moved.admit("y", subject_kind="repository")
    assert moved.adopt("/repo") == 1
    with pytest.raises(MemoryError_, match="nothing in this store"):
        moved.adopt("/repo")


def test_export_and_import_round_trip(spark, book, tmp_path):
    first = book.admit('Quote " and ü\n', [("range", "a.py:1-2")], subject_kind="commit", subject_commit_sha="abcdef1")
    book.supersede(first, "Then this", subject_kind="definition", subject_path="a.py", subject_qualname="f")
    out = str(tmp_path / "out")
    assert book.export(out) == 2
    lines = [r[0] for r in spark.read.text(out).collect()]
    assert json.loads(lines[0])["count"] == 2 and len(lines) == 3
    assert list(json.loads(lines[1]))[:3] == ["memory_id", "repository", "statement"]

    other = MemoryBook(spark, Store(spark, str(tmp_path / "other")), "/other")
    with pytest.raises(MemoryError_, match="made about"):
        other.take_in(out, "/wrong")
    assert other.take_in(out, "/repo", dry_run=True)["imported"] == 2
    assert other.read().count() == 0
    assert other.take_in(out, "/repo")["imported"] == 2
    assert other.take_in(out, "/repo") ["skipped"] == 2
    got = {r["memory_id"]: r["statement"] for r in other.read().collect()}
    assert got[first] == 'Quote " and ü'
    assert other.citations().count() == 1


BAD = [
    ("", "blank"),
    ('{"memory_id": "x"}', "lacks a key"),
    ("REPLACE:memory_id:nope", "uuid"),
    ("REPLACE:admitted_at:2024-01-01T00:00:00", "offset"),
    ("REPLACE:state:gone", "state"),
    ("ADD:extra:1", "does not have"),
]


@pytest.mark.parametrize("change, message", BAD)
def test_one_bad_line_refuses_the_file(spark, book, tmp_path, change, message):
    book.admit("fine", subject_kind="repository")
    out = tmp_path / "out"
    book.export(str(out))
    lines = [r[0] for r in spark.read.text(str(out)).collect()]
    if ":" in change and not change.startswith("{"):
        act, key, value = change.split(":", 2)
        lines[1] = json.dumps({**json.loads(lines[1]), key: value})
    else:
        lines[1] = change
    path = tmp_path / "bad.jsonl"
    path.write_text("\n".join(lines) + "\n")
    other = MemoryBook(spark, Store(spark, str(tmp_path / "other")), "/other")
    with pytest.raises(MemoryError_, match=message):
        other.take_in(str(path), "/repo")
    assert other.read().count() == 0
