import random

import pytest

from gitloom.operators import evidence as ev
from gitloom.operators import memory as m
from gitloom.operators import structure as st
from gitloom.operators.sequence import ordered
from tests import walks


def _random_file(rng, life):
    """Versions of one file: letters, parse failures, versions nobody stored, names that repeat."""
    n = rng.randint(1, 12)
    events, versions, definitions, told, held = [], [], [], [], {}
    for i in range(n):
        sha = f"{life}-{i:02d}"
        letter = "D" if rng.random() < 0.2 else "M"
        events.append(("r", life, i, sha, f"{life}.py", letter))
        if letter == "D":
            told.append((sha, "file_end" if i == n - 1 else "not_in_tree"))
            continue
        roll = rng.random()
        if roll < 0.15:
            told.append((sha, "not_stored"))
            continue
        if roll < 0.3:
            versions.append(("r", sha, f"{life}.py", "SyntaxError: x"))
            told.append((sha, "parse_failed"))
            continue
        versions.append(("r", sha, f"{life}.py", None))
        told.append((sha, "read"))
        held[sha] = [
            (rng.choice(["function", "class"]), rng.choice("fg"), rng.choice("xyz")) for _ in range(rng.randint(0, 4))
        ]
        definitions += [("r", sha, f"{life}.py", k, *d, 1, 2, []) for k, d in enumerate(held[sha])]
    return events, versions, definitions, told, held


@pytest.mark.parametrize("ranges", [None, 6])
def test_definition_history_matches_a_walk(spark, ranges):
    rng = random.Random(5)
    files = {f"{i:03d}": _random_file(rng, f"{i:03d}") for i in range(60)}
    flat = lambda at: [row for parts in files.values() for row in parts[at]]
    events = spark.createDataFrame(
        flat(0), "repo_id string, life_id string, n int, commit_sha string, path string, change_type string"
    )
    versions = spark.createDataFrame(flat(1), "repo_id string, commit_sha string, path string, parse_error string")
    definitions = spark.createDataFrame(
        flat(2),
        "repo_id string, commit_sha string, path string, position int, kind string, qualname string,"
        " fingerprint string, lineno int, end_lineno int, decorators array<string>",
    )
    lives = ordered(events, ["n", "life_id"], ranges=ranges)
    found = st.definition_history(lives, versions, definitions)
    got = {
        (r["life_id"], r["kind"], r["qualname"], r["occurrence"], r["change"], r["commit_sha"],
         r["previous_commit_sha"], r["blind_spots"])
        for r in found.events.collect()
    }
    tails = {
        (r["life_id"], r["kind"], r["qualname"], r["occurrence"]): r["unresolved"]
        for r in found.lives.where("unresolved > 0").collect()
    }
    want, unresolved = set(), {}
    for life, (_, _, _, told, held) in files.items():
        walked, tail = walks.definition_events(told, held)
        want |= {(life, *e) for e in walked}
        unresolved |= {(life, *slot): n for slot, n in tail.items()}
    assert got == want
    assert tails == unresolved


@pytest.mark.parametrize("ranges", [3, 11])
def test_running_totals_do_not_depend_on_ranges(spark, ranges):
    rng = random.Random(2)
    rows = [
        ("r", rng.choice([1, 1, 1, 2]), i, f"c{i:03d}", "p", rng.choice("AMMRD"), rng.choice([None, 0, 5]), rng.choice([0, 2]))
        for i in range(200)
    ]
    frame = spark.createDataFrame(
        rows,
        "repo_id string, life_id long, n int, commit_sha string, path string, change_type string,"
        " added_lines long, deleted_lines long",
    )
    one = ev.running_statistics(ordered(frame, ["n"])).drop("_chunk")
    many = ev.running_statistics(ordered(frame, ["n"], ranges=ranges)).select(*one.columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


@pytest.mark.parametrize("ranges", [None, 5])
def test_prefixes_of_any_length_resolve(spark, ranges):
    rng = random.Random(9)
    shas = sorted({f"{rng.randrange(16**8):08x}"[: rng.choice([8])] for _ in range(300)} | {"aaaaaaa1", "aaaaaaa2"})
    refs = [s[: rng.randint(1, 8)] for s in rng.sample(shas, 60)] + ["aaaaaaa", "AAAAAAA1", "zz", "00000000f"]
    commits = spark.createDataFrame([("r", s, i) for i, s in enumerate(shas)], "repo_id string, sha string, committed_epoch long")
    asked = spark.createDataFrame([("r", r) for r in refs], "repo_id string, ref string")
    got = {r["ref"]: (r["candidates"], r["sha"]) for r in m.resolve_prefixes(asked, commits, ranges=ranges).collect()}
    for ref in {r.lower() for r in refs}:
        named = [s for s in shas if s.startswith(ref)]
        assert got[ref] == (len(named), named[-1] if named else None)


@pytest.mark.parametrize("ranges", [None, 4])
def test_acts_fold_in_order(spark, ranges):
    acts = [
        ("a", "admit", 1), ("a", "admit", 2), ("a", "invalidate", 3), ("a", "supersede", 4),
        ("b", "supersede", 1), ("b", "admit", 2), ("b", "supersede", 5),
        ("c", "invalidate", 1), ("d", "admit", 7),
    ]
    frame = spark.createDataFrame([(i, *a, f"d{i}") for i, a in enumerate(acts)], "n int, memory_id string, act string, at long, detail string")
    rows = {r["memory_id"]: r for r in m.fold_acts(ordered(frame, ["n"], ranges=ranges)).collect()}
    assert {k: (r["state"], r["admitted_epoch"], r["ended_epoch"], r["refused"]) for k, r in rows.items()} == {
        "a": ("invalidated", 1, 3, 2), "b": ("superseded", 2, 5, 1), "d": ("active", 7, None, 0),
    }
    assert rows["a"]["end_reason"] == "d2" and rows["b"]["superseded_by"] == "d6"


def test_versions_of_a_definition_are_compared_in_one_pass(spark, monkeypatch):
    """Each definition is placed beside its earlier version by one window, not by a join of the table with itself."""
    built, write = {}, st.materialise
    monkeypatch.setattr(st, "materialise", lambda frame, name: built.setdefault(name, frame) and write(frame, name))
    events = spark.createDataFrame(
        [("r", "f", n, f"c{n}", "f.py", "M") for n in range(4)],
        "repo_id string, life_id string, n int, commit_sha string, path string, change_type string",
    )
    versions = spark.createDataFrame(
        [("r", f"c{n}", "f.py", None) for n in range(4)], "repo_id string, commit_sha string, path string, parse_error string"
    )
    # Without a name nothing is the same definition again.
    held = [(0, "a", "1"), (1, "a", "2"), (2, None, "1"), (3, "a", "2"), (3, "a", "2")]
    definitions = spark.createDataFrame(
        [("r", f"c{n}", "f.py", k, "function", name, print_, 1, 2, []) for k, (n, name, print_) in enumerate(held)],
        "repo_id string, commit_sha string, path string, position int, kind string, qualname string,"
        " fingerprint string, lineno int, end_lineno int, decorators array<string>",
    )
    found = st.definition_history(ordered(events, ["n"]), versions, definitions)
    got = sorted((r["commit_sha"], r["qualname"] or "", r["occurrence"], r["change"]) for r in found.events.collect())
    assert got == [
        ("c0", "a", 0, "created"), ("c1", "a", 0, "modified"), ("c2", "", 0, "created"), ("c2", "a", 0, "deleted"),
        ("c3", "", 0, "deleted"), ("c3", "a", 0, "created"), ("c3", "a", 1, "created"),
    ]
    told = built["moved"]._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in told and "Window" in told
