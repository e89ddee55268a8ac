"""Rows are moved to where they meet once, and tables that several parts of a query need are made once."""

import random

from pyspark.sql import functions as F

from gitloom.operators import answers as an
from gitloom.operators import bundles as bu
from gitloom.operators import evidence as ev
from gitloom.operators import lifecycle as lc
from gitloom.plans import evidence as pe
from gitloom.sources import adapters as a

SF = "/root/testdata/sf0.001"


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def _documents(spark, by_unit):
    rows = {
        "commits": [("r", u, 1, u, 0, f"m {u}") for u in "ab"],
        "changes": [("r", u, p, 1, None, None) for u in "ab" for p in ("y", "x")],
        "ranges": [("r", "a", "x", 2, 5, 6), ("r", "a", "x", 1, 1, 2), ("r", None, "x", 1, 1, 1)],
    }
    frames = {k: spark.createDataFrame(v, f"repo_id string, unit string, {bu.SHAPES[k]}") for k, v in rows.items()}
    return bu.sections(**{k: f.repartition("unit") if by_unit else f for k, f in frames.items()})


def test_a_document_is_put_together_in_one_grouping(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        apart, placed = bu.documents(_documents(spark, False)), bu.documents(_documents(spark, True), placed=True)
        assert _plan(apart).split("Union")[0].count("Exchange") == 1
        got = [sorted((r["unit"], r["document"]) for r in found.collect()) for found in (apart, placed)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got[0] == got[1] and [u for u, _ in got[0]] == ["a", "b"]
    spans = '[{"start":1,"end":2},{"start":5,"end":6}]'
    assert f'"file_changes":[{{"path":"x","added_lines":1,"deleted_lines":null,"ranges":{spans},"ranges_total":null}},' in got[0][0][1]
    assert got[0][1][1].endswith('"lifecycle":[],"ast_changes":[],"cochange":[],"history":[],"absences":[]}')


def test_earlier_commits_walked_and_looked_up_alike(spark, monkeypatch):
    monkeypatch.setattr(ev, "STRETCH", 8)
    lives = [(life, n) for life, size in ((1, 40), (2, 1), (3, 9)) for n in range(1, size + 1)]
    totals = spark.createDataFrame(
        [("r", life, n, f"{life}-{n}", "M", n, None) for life, n in lives] + [("r", None, 3, "x", "M", 1, 1)],
        "repo_id string, life_id long, commits long, commit_sha string, change_type string, added_lines long, deleted_lines long",
    )
    dice = random.Random(3)
    asked = [("r", f"u{i}", *dice.choice(lives)) for i in range(60)] + [("r", "u1", 1, 9), ("r", None, 1, 9), ("r", "u", None, 4), (None, "u", 1, 9)]
    left = spark.createDataFrame(asked, "repo_id string, unit string, life_id long, first_position long")
    looked, walked = ev.earlier_commits(totals, left), ev.earlier_commits(totals, left, many=True)
    rows = lambda f: sorted(map(str, f.select(*looked.columns).collect()))
    assert rows(looked) == rows(walked) and len(rows(looked)) > 100


def test_spans_of_a_file_meet_once(spark):
    rows = [("r", "u", "x", s, s + 1) for s in (9, 3, 3, 10, 9)] + [("r", "u", None, 1, 1), ("r", None, "x", 1, 1)]
    found = bu.numbered_ranges(spark.createDataFrame(rows, "repo_id string, unit string, path string, start int, end int"))
    assert _plan(found).count("Exchange") == 1
    got = {(r["unit"], r["path"], r["start"]): r["nth"] for r in found.collect()}
    assert got == {("u", "x", 3): 1, ("u", "x", 9): 2, ("u", "x", 10): 3, ("u", None, 1): 1, (None, "x", 1): 1}


def test_orders_are_walked_once(spark, monkeypatch):
    walked, made, write = [], [], pe.materialise
    order = a.ordered
    monkeypatch.setattr(a, "ordered", lambda *x, **y: walked.append(x[1]) or order(*x, **y))
    monkeypatch.setattr(pe, "materialise", lambda f, name: made.append(name) or write(f, name))
    assert pe.absences(spark, SF).count() > 0
    assert len(walked) == 1 and made == ["changes"]


def test_definitions_are_grouped_where_their_tip_was_found(spark):
    events = spark.createDataFrame(
        [("r", c, p, "f", 0, "function", "created" if c == "1" else "modified", 1, 4 + int(c)) for c in "12" for p in "xy"],
        "repo_id string, commit_sha string, path string, qualname string, occurrence int, kind string, change string, lineno int, end_lineno int",
    )
    members = spark.createDataFrame([("r", "u", "1", 1), ("r", "u", "2", 2)], "repo_id string, unit string, commit_sha string, ordinal long")
    steps = spark.createDataFrame(
        [("r", "1", "x", "read"), ("r", "2", "x", "parse_failed"), ("r", "1", "y", "read")], "repo_id string, commit_sha string, path string, state string"
    )
    found = ev.definition_presence(events, members, steps)
    plan = _plan(found)
    assert "Aggregate" in plan.split("Join")[0]
    got = {r["path"]: (r["size"], r["events"], r["presence_base"], r["presence_tip"]) for r in found.collect()}
    assert got == {"x": (6, 2, "absent", "unreadable"), "y": (6, 2, "absent", "present")}


def test_only_trees_with_a_later_parent_are_walked_again(spark, monkeypatch):
    # Two lines start at the same root "r" of a clock far ahead; "m" merges a short line and a long one walked later.
    times = {"r": 100, "a1": 1, "b1": 2, "b2": 50, "m": 3, "n": 4, "s": 100, **{f"c{i}": i + 1 for i in range(30)}}
    parents = [("a1", "r"), ("b1", "r"), ("b2", "b1"), ("m", "a1"), ("m", "b2"), ("n", "m"), ("c0", "s")]
    parents += [(f"c{i}", f"c{i - 1}") for i in range(1, 30)]
    commits = spark.createDataFrame([("x", s, t) for s, t in times.items()], "repo_id string, sha string, committed_epoch long")
    edges = spark.createDataFrame([("x", c, p) for c, p in parents], "repo_id string, commit_sha string, parent_sha string")
    sizes, write = [], lc.materialise

    def counted(frame, name):
        told = write(frame, name)
        sizes.append((name, told.count()))
        return told

    monkeypatch.setattr(lc, "materialise", counted)
    keys = {r["sha"]: tuple((x["t"], x["s"]) for x in r["walk_key"]) for r in lc.walk_keys(commits, edges).collect()}
    above = {c: [p for q, p in parents if q == c] for c in times}

    def key(c):
        own = (times[c], c)
        return max([*[(*[x for x in key(p) if x > own], own) for p in above[c]], (own,)])

    assert keys == {c: key(c) for c in times}
    names = [n for n, _ in sizes]
    again = [n for i, (name, n) in enumerate(sizes) if name == "waits" and "follows" in names[:i]]
    assert again and max(again) < 10


def test_pointers_are_grouped_where_their_statement_is(spark):
    plan = _plan(a.memory_citations(spark, SF))
    assert plan.count("Exchange") == 1 and "hashpartitioning(lpad(" in plan


def test_answers_are_taken_apart_in_one_pass(spark, monkeypatch):
    made, write = [], an.materialise
    monkeypatch.setattr(an, "materialise", lambda f, name: made.append(name) or write(f, name))
    rows = spark.createDataFrame([("i", 8, 1, 2, 3), ("k", 8, 1, 3, 4), (None, 8, 1, 3, 4)], "answer_id string, p long, q int, s long, o long")
    known = a.answer_evidence(rows)
    found = an.violations(a.answers(rows), known, a.answer_memories(rows))
    assert {(r["answer_id"], r["rule"]) for r in found.collect()} == {(None, "evidence_not_held"), (None, "memory_not_shown")}
    assert made == ["shaped"]
    assert _plan(known).count("Exchange") == 2 and _plan(known.distinct()).count("Exchange") == 2
