import json

import pytest
from pyspark.sql import functions as F

from gitloom import cli
from gitloom.memories import MemoryBook, MemoryError_
from gitloom.sources.store import StoreError
from tests.gitrepo import Repo


@pytest.fixture(scope="module")
def ask(spark, tmp_path_factory):
    repo = Repo(tmp_path_factory.mktemp("cli"))
    shas = [
        repo.commit("one", {"a.py": "def f():\n    return 1\n", "b.txt": "1\n"}),
        repo.commit("two", {"a.py": "def f():\n    return 2\n", "b.txt": "2\n"}),
        repo.commit("three", move=[("a.py", "c.py")]),
    ]
    db = str(tmp_path_factory.mktemp("db") / "store")

    def run(*argv):
        return cli.run(spark, [*argv, "--repo", repo.path, "--db", db])

    with pytest.raises(StoreError):
        run("timeline")
    assert run("analyze")["commits"] == 3
    assert run("ast")["definitions"] == 3
    return run, shas


def test_history_commands(ask):
    run, shas = ask
    assert [c["sha"] for c in run("timeline")["commits"]] == shas[::-1]
    assert len(run("timeline", "-n", "1")["commits"]) == 1
    hot = run("hotspots")["files"]
    assert [(f["path"], f["commits"], f["path_history"]) for f in hot] == [("c.py", 3, ["a.py", "c.py"]), ("b.txt", 2, ["b.txt"])]
    assert [f["state"] for f in run("files")["files"]] == ["alive", "alive"]
    one = run("file", "./a.py")["files"]
    assert (one[0]["path"], one[0]["renames"], one[0]["modifications"]) == ("c.py", 1, 1)
    assert run("commit", shas[2][:10])["files"][0]["path"] == "a.py → c.py"
    with pytest.raises(LookupError):
        run("commit", "0000000")


def test_cochange_and_structure(ask):
    run, shas = ask
    report = run("cochange", "b.txt")["files"][0]
    assert report["co_changes"] == [{"path": "c.py", "shared_commits": 2, "score": 1.0}]
    version = run("structure", "c.py")
    assert (version["state"], version["compared_with"]) == ("read", shas[1])
    assert [(d["qualname"], d["change_type"]) for d in version["definitions"]] == [("f", "unchanged")]
    life = run("structure", "a.py", "--history")["files"][0]["lives"][0]
    assert [e["change"] for e in life["events"]] == ["created", "modified"]


def test_memory_commands(ask):
    run, shas = ask
    made = run(
        "memory", "create", "Keep f pure", "--about-path", "c.py", "--cite-commit", shas[1][:8],
        "--cite-range", "a.py:2-2", "--cite-cochange", "b.txt -> c.py", "--since-commit", shas[0],
    )["memory_id"]
    shown = run("memory", "show", made[:8])
    assert {c["kind"]: c["resolution"] for c in shown["citations"]} == {
        "commit": "resolved", "range": "resolved", "cochange": "resolved"
    }
    assert shown["subject"]["resolution"] == "resolved"
    assert shown["since"]["commit"] == shas[0] and len(shown["since"]["commit_date"]) == 10
    listed = run("memory", "list")["memories"]
    assert {c["kind"]: c["resolution"] for c in listed[0]["citations"]}["range"] == "not_checked"
    document = run("explain", shas[1])
    assert (document["commit"], document["state"], document["explanation"]) == (shas[1], "evidence_only", None)
    assert [x["memory_id"] for x in document["memory"]["in_force"]] == [made]
    run("memory", "invalidate", made, "--reason", "gone")
    assert run("memory", "list")["memories"] == []
    with pytest.raises(MemoryError_):
        run("memory", "invalidate", made, "--reason", "again")


def test_a_start_is_shown_with_its_day(spark, tmp_path):
    """The day its newest commit recorded, in the committer's own offset."""
    s = cli.Session(spark, "/r", str(tmp_path / "store"))
    days = [("abcdef1aaa", "2024-05-02T23:30:00-05:00", 20), ("abcdef1bbb", "2024-05-01T00:00:00+00:00", 10)]
    schema = "repo_id string, sha string, committed_at string, committed_epoch long"
    commits = spark.createDataFrame([("/r", *day) for day in days], schema)
    rest = [f for f in s.store.empty("commits").schema if f.name not in commits.columns]
    s.store.append("commits", commits.withColumns({f.name: F.lit(None).cast(f.dataType) for f in rest}))
    book = MemoryBook(spark, s.store, "/r")
    for statement, fields in [
        ("held", {"since_commit_sha": "abcdef1bbb"}), ("lost", {"since_commit_sha": "fffffff"}),
        ("day", {"since_date": "2024-01-01"}), ("open", {}),
    ]:
        book.admit(statement, subject_kind="repository", **fields)
    told = {o["statement"]: o["since"] for o in cli._memory_objects(s, book.read(), ["memory_id"], deep=False)}
    assert told == {
        "held": {"commit": "abcdef1bbb", "commit_date": "2024-05-02"},
        "lost": {"commit": "fffffff", "commit_date": None}, "day": {"date": "2024-01-01"}, "open": None,
    }


POINTLESS = [
    (["--about-definition", "c.py:g"], "subject not found: definition"),
    (["--cite-definition", "f", "--cite-definition", "g"], "citation not found: definition g"),
    (["--cite-file", "a.py", "--cite-range", "a.py:2-2"], "citation not found: range"),
]


@pytest.mark.parametrize("words, refusal", POINTLESS)
def test_what_a_memory_points_at_has_to_be_there(ask, words, refusal):
    run, _ = ask
    with pytest.raises(MemoryError_, match=refusal):
        run("memory", "create", "Never so", *words)


def test_answers_are_json(ask):
    run, shas = ask
    found = run("explain", f"{shas[0]}..{shas[2]}")
    json.dumps(found)
    assert found["range"] == f"{shas[0]}..{shas[2]}" and "selection" not in found
    assert run("runs")["runs"] == []


def test_a_model_answer_is_checked_and_recorded(ask, tmp_path):
    run, shas = ask

    def answer(ref, kind="range"):
        evidence = [{"id": "e1", "kind": kind, "ref": ref, "detail": "d"}, {"id": "e2", "kind": "commit", "ref": shas[1][:9], "detail": "d"}]
        told = {
            "summary": "f returns another number [oc1]", "observed_changes": [{"id": "oc1", "statement": "moved", "evidence": ["e1", "e2"]}],
            "evidence": evidence, "possible_reasons": [{"statement": "a fix", "based_on": ["oc1"]}], "uncertainty": [],
            "related_memory": [],
        }
        path = tmp_path / "answer.json"
        path.write_text(json.dumps(told))
        return run("explain", shas[1], "--answer", str(path), "--model", "m", "--provider", "p")

    with pytest.raises(ValueError, match="evidence_not_held"):
        answer("a.py:3-3")
    assert run("runs")["runs"] == []
    found = answer("a.py:2-2")
    assert found["state"] == "explained"
    assert found["explanation"]["possible_reasons"][0]["confidence"] == {"observed_changes": 1, "commits": [shas[1][:8]]}
    recorded = run("runs")["runs"]
    assert [(r["unit_spec"], r["model"], r["bundle_sha256"]) for r in recorded] == [(shas[1], "m", found["bundle_sha256"])]
    assert answer("c.py", "file")["state"] == "explained"
