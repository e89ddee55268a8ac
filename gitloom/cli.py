"""The command line: python -m gitloom COMMAND …"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitloom import explain as ex
from gitloom import ingest
from gitloom.functions import text
from gitloom.memories import MemoryBook, MemoryError_
from gitloom.operators import cochange as cc
from gitloom.operators import history as h
from gitloom.operators import lifecycle as lc
from gitloom.operators import memory as m
from gitloom.operators import structure as st
from gitloom.operators import sync
from gitloom.operators.documents import newest_runs
from gitloom.operators.lifecycle import REPO, SEQ
from gitloom.session import local_session, materialise, release
from gitloom.sources import git
from gitloom.sources.store import Store, StoreError, store_path


class Session:
    """One repository, its store, and the frames the commands share."""

    def __init__(self, spark: SparkSession, root: str, base: str | None = None):
        self.spark, self.root = spark, root
        self.store = Store(spark, base or store_path(root))
        self.repo = root
        self.roots = {self.repo: root}

    def table(self, name: str) -> DataFrame:
        return self.store.read(name).where(F.col(REPO) == self.repo)

    def opened(self) -> "Session":
        self.store.require(self.root)
        return self

    def head(self) -> str | None:
        return self.store.meta(f"head_sha:{self.repo}")

    def envelope(self, **content) -> dict:
        return {"repository": self.root, "head_sha": self.head(), **content}

    def notes(self) -> list[str]:
        """What a reader should know; printed beside the answer, never in it."""
        found = []
        if self.head() != git.head_sha(self.root):
            found.append("the repository has moved on since it was analysed; run analyze")
        if git.is_shallow(self.root):
            found.append("the repository is a shallow clone, so its history is cut short")
        return found

    def lives(self):
        tables = [self.table(t) for t in ("commits", "commit_files", "commit_parents")]
        return sync.stored_lives(*tables).stored("lives")

    def book(self) -> MemoryBook:
        return MemoryBook(self.spark, self.store, self.root, lambda acts, cited: _unheld(self, acts, cited))


def _with_names(rows: DataFrame, lives) -> DataFrame:
    """Adds path_history. The rows asked for are few; only their lives are read."""
    mine = lives.of(lives.frame.join(rows.select(REPO, "life_id"), [REPO, "life_id"], "left_semi"))
    listed = (
        lc.path_history(mine)
        .groupBy(REPO, "life_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct(SEQ, "path"))), lambda x: x["path"]).alias("path_history"))
    )
    return rows.join(listed, [REPO, "life_id"])


def _dicts(frame: DataFrame, *columns) -> list[dict]:
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return [json.loads(r[0]) for r in frame.select(row).toLocalIterator()]


def _limit(args) -> int | None:
    return None if args.all else args.limit


# ------------------------------------------------------------------ history


def analyze(s: Session, args):
    totals = ingest.analyze(s.spark, s.store, s.roots).where(F.col(REPO) == s.repo).first()
    return totals.asDict() if totals else {"commits": 0}


def parse(s: Session, args):
    tallies = ingest.parse(s.spark, s.opened().store, s.roots).first()
    return tallies.asDict() if tallies else {"file_versions": 0}


def timeline(s: Session, args):
    rows = h.timeline(s.opened().table("commits"), s.table("commit_files"), limit=_limit(args))
    columns = ["sha", "date", "author", "files_changed", "insertions", "deletions", "message"]
    return s.envelope(commits=_dicts(rows, *columns))


FILE_COLUMNS = ["commits", "additions", "deletions", "path_history"]


def hotspots(s: Session, args):
    lives = s.opened().lives()
    ranked = materialise(lc.hotspots(lc.file_statistics(lives.frame), limit=_limit(args)), "ranked")
    rows = _with_names(ranked, lives).orderBy(F.desc("commits"), "current_path", "life_id")
    return s.envelope(files=_dicts(rows, F.col("current_path").alias("path"), *FILE_COLUMNS))


def files(s: Session, args):
    lives = s.opened().lives()
    listed = materialise(lc.inventory(lc.file_statistics(lives.frame)), "listed")
    rows = _with_names(listed, lives).orderBy("current_path", "life_id")
    return s.envelope(files=_dicts(rows, F.col("current_path").alias("path"), "state", *FILE_COLUMNS))


def file(s: Session, args):
    lives = s.opened().lives()
    path = _normal(args.file)
    held = lives.frame.join(lc.lives_of_path(lives.frame, path), [REPO, "life_id"], "left_semi")
    rows = _with_names(materialise(lc.file_statistics(held), "file"), lives).orderBy("life_id")
    columns = [
        F.col("current_path").alias("path"), "commits", "additions", "deletions", "renames",
        F.col("is_deleted").alias("deleted"), "created_at", "created_sha", "last_modified_at",
        "last_modified_sha", "deleted_at", "deleted_sha", "modifications", "binary_changes", "path_history",
        "net_change",
    ]
    return {"path": path, "files": _dicts(rows, *columns)}


def commit(s: Session, args):
    detail = h.commit_detail(s.opened().table("commits"), s.table("commit_files"), args.sha)
    return s.envelope(files=_dicts(detail, "commit_sha", F.col("shown_path").alias("path"), "change", "lines", "similarity"))


def cochange(s: Session, args):
    lives = s.opened().lives()
    path = _normal(args.file)
    stats = materialise(lc.file_statistics(lives.frame), "statistics")
    asked = lc.lives_of_path(lives.frame, path)
    reports, partners = cc.cochange(
        lives.frame, asked, stats, large_commit_limit=args.large_commit_limit, min_shared=args.min_shared
    )
    named = _with_names(stats.join(asked, [REPO, "life_id"], "left_semi"), lives)
    heads = reports.withColumnRenamed("asked_life", "life_id").join(named, [REPO, "life_id"]).orderBy("life_id")
    found = _dicts(
        heads, "life_id", F.col("current_path").alias("path"), "path_history", "analyzed_commits",
        "large_commits_excluded", "hidden_pairs",
    )
    rows = _dicts(cc.strongest_first(partners), "asked_life", "path", "shared_commits", "score")
    limit = _limit(args)
    for entry in found:
        life = entry.pop("life_id")
        entry["co_changes"] = [
            {k: r[k] for k in ("path", "shared_commits", "score")} for r in rows if r["asked_life"] == life
        ][:limit]
    return s.envelope(path=path, files=found)


def structure(s: Session, args):
    lives = s.opened().lives()
    path = _normal(args.file)
    asked = lc.lives_of_path(lives.frame, path)
    mine = lives.of(lives.frame.join(asked, [REPO, "life_id"], "left_semi")).stored("asked")
    definitions = s.table("definition_versions")
    found = st.definition_history(mine, s.table("file_versions"), definitions)
    if args.history:
        return {"path": path, "files": _histories(mine, found)}
    steps = found.steps if args.commit is None else found.steps.where(F.col("commit_sha").startswith(args.commit.lower()))
    version = steps.orderBy(F.desc("life_id"), F.desc(SEQ)).first()
    if version is None:
        raise LookupError(f"no version of {path}")
    at = (F.col("commit_sha") == version["commit_sha"]) & (F.col("path") == version["path"])
    blind = found.gaps.where(
        (F.col("life_id") == version["life_id"]) & (F.col("step") == version["step"]) & (F.col(SEQ) < version[SEQ])
    )
    read = version["state"] == "read"
    rows = definitions.where(at).orderBy("position") if read else definitions.limit(0)
    columns = ["qualname", "kind", "lineno", "end_lineno", "decorators", "change_type"]
    names = lc.path_history(mine).where(F.col("life_id") == version["life_id"]).orderBy(SEQ)
    return {
        "path": version["path"],
        "path_history": [r["path"] for r in names.collect()],
        "commit_sha": version["commit_sha"],
        "committed_at": version["committed_at"],
        **_state(version),
        "compared_with": version["previous_commit_sha"] if read else None,
        "blind_spots": [r["commit_sha"] for r in blind.orderBy(SEQ).collect()] if read else [],
        "definitions": _dicts(rows, *columns),
    }


def _state(version) -> dict:
    failed = version["state"] == "parse_failed"
    reasons = {"not_stored": "no version stored", "parse_failed": "parse failed"}
    reason = None if version["state"] == "read" else reasons.get(version["state"], "not in this commit")
    return {
        "state": "unavailable" if reason else "read",
        "reason": reason,
        "parse_error": version["parse_error"] if failed else None,
        "error_lineno": version["error_lineno"] if failed else None,
        "error_offset": version["error_offset"] if failed else None,
    }


def _histories(mine, found) -> list[dict]:
    names: dict = {}
    for r in lc.path_history(mine).orderBy("life_id", SEQ).toLocalIterator():
        names.setdefault(r["life_id"], []).append(r["path"])
    versions: dict = {}
    for r in found.steps.orderBy("life_id", SEQ).toLocalIterator():
        versions.setdefault(r["life_id"], []).append(
            {"commit_sha": r["commit_sha"], "path": r["path"], "committed_at": r["committed_at"], **_state(r)}
        )
    gaps: dict = {}
    for r in found.gaps.orderBy("life_id", SEQ).toLocalIterator():
        gaps.setdefault((r["life_id"], r["step"]), []).append(r["commit_sha"])
    moments = found.steps.select(REPO, "life_id", "commit_sha", "committed_at").distinct()
    lives: dict = {}
    order = ["life_id", "step", "kind", "qualname", "occurrence"]
    for r in found.events.join(moments, [REPO, "life_id", "commit_sha"]).orderBy(*order).toLocalIterator():
        slot = lives.setdefault(r["life_id"], {}).setdefault((r["kind"], r["qualname"], r["occurrence"]), [])
        slot.append(
            {
                "change": r["change"], "commit_sha": r["commit_sha"], "path": r["path"],
                "committed_at": r["committed_at"], "lineno": r["lineno"], "end_lineno": r["end_lineno"],
                "decorators": list(r["decorators"] or []), "previous_commit_sha": r["previous_commit_sha"],
                "blind_spots": gaps.get((r["life_id"], r["step"]), []),
            }
        )
    last = {r["life_id"]: r["s"] for r in found.steps.groupBy("life_id").agg(F.max("step").alias("s")).collect()}
    return [
        {
            "path_history": names[life],
            "versions": versions[life],
            "lives": [
                {
                    "qualname": name, "kind": kind, "occurrence": n, "events": events,
                    "unresolved": [] if events[-1]["change"] == "deleted" else gaps.get((life, last[life] + 1), []),
                }
                for (kind, name, n), events in lives.get(life, {}).items()
            ],
        }
        for life in sorted(names)
    ]


def explain(s: Session, args):
    s.opened()
    if ".." in args.revision:
        base, tip = git.resolve_range(s.root, args.revision)
        unit = ex.Unit(s.repo, s.root, tip, base)
    else:
        unit = ex.Unit(s.repo, s.root, git.resolve(s.root, args.revision))
    found = ex.build(s.spark, s.store, unit)
    seen, section, told = ex.shown(s.spark, found), _section(s, found), None
    if args.view:
        return seen.document
    if args.answer:
        with open(args.answer, encoding="utf-8") as file:
            answer = file.read()
        broken = ex.broken_rules(s.spark, found, seen, answer, _shown_memories(section))
        if broken:
            raise ValueError(f"the answer breaks: {', '.join(broken)}")
        told = ex.explanation(s.spark, answer)
        ex.record(s.store, found, args.provider, args.model, args.prompt)
    return ex.envelope(found, seen, told, section)


def _shown_memories(section: dict | None) -> list[str]:
    lists = ("in_force", "not_provably_in_force")
    return [m["memory_id"] for name in lists for m in (section or {}).get(name, [])]


def runs(s: Session, args):
    rows = newest_runs(s.opened().store.read("explain_runs"), args.limit)
    columns = ["unit_kind", "unit_spec", "bundle_sha256", "provider", "model", "prompt_sha256", "created_at"]
    return s.envelope(runs=_dicts(rows, *columns))


# ------------------------------------------------------------------ memories


def _resolved(s: Session, cited: DataFrame, deep: bool) -> DataFrame:
    """Citations with what became of each."""
    cited = materialise(cited.withColumn(REPO, F.lit(s.repo)), "cited")
    kinds = {r["kind"] for r in cited.select("kind").distinct().collect()}
    lives = s.lives()
    stats = lc.file_statistics(lives.frame)
    empty = s.spark.createDataFrame([], f"{REPO} string, commit_sha string, path string, start int, end int")
    ranges = _ranges_of_cited(s, cited) if deep and "range" in kinds else empty
    return m.resolve_citations(
        cited, s.table("commits"), lives.frame, s.table("definition_versions"), ranges, stats,
        deep=deep and bool(kinds & {"range", "cochange"}),
    )


def _ranges_of_cited(s: Session, cited: DataFrame) -> DataFrame:
    """Where the cited commits changed lines."""
    refs = cited.where("kind = 'commit'").select(REPO, text.hex_prefix(F.col("ref")).alias("ref"))
    named = m.resolve_prefixes(refs, s.table("commits")).where("candidates > 0").select(REPO, F.col("sha").alias("unit"))
    units = named.distinct().withColumn("root", F.lit(s.root))
    section = F.col("section")
    return (
        git.commit_patches(units)
        .select(REPO, F.col("unit").alias("commit_sha"), text.new_side_path(section).alias("path"),
                F.explode(text.new_side_ranges(section)).alias("_r"))
        .where("path is not null")
        .select(REPO, "commit_sha", "path", "_r.start", "_r.end")
    )


def _subject_states(s: Session, memories: DataFrame) -> DataFrame:
    """Whether what each memory is about is still there."""
    tables = [s.table(t) for t in ("commits", "commit_files", "definition_versions")]
    return m.resolve_subjects(memories.withColumn(REPO, F.lit(s.repo)), *tables)


def _unheld(s: Session, acts: DataFrame, cited: DataFrame) -> DataFrame:
    """What an act points at has to be there when it is written."""
    return m.unheld(_subject_states(s, acts), _resolved(s, cited, deep=True))


def _memory_objects(s: Session, memories: DataFrame, order: list, deep: bool) -> list[dict]:
    memories = materialise(memories, "shown-memories")
    cited = s.book().citations().join(memories.select("memory_id"), "memory_id", "left_semi")
    resolved = _resolved(s, cited, deep)
    listed = resolved.groupBy("memory_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "kind", "ref", "resolution"))).alias("citations")
    )
    older = m.supersede_links(s.book().read()).select("memory_id", "supersedes")
    dated = m.start_moments(memories.withColumn(REPO, F.lit(s.repo)), s.table("commits"))
    rows = _subject_states(s, dated).join(listed, "memory_id", "left").join(older, "memory_id", "left")
    found = []
    for r in rows.orderBy(*order).toLocalIterator():
        kind = r["subject_kind"]
        subject = {"kind": kind}
        if kind in ("path", "definition"):
            subject["path"] = r["subject_path"]
        if kind == "definition":
            subject["qualname"] = r["subject_qualname"]
        if kind == "commit":
            subject["commit"] = r["subject_commit_sha"]
        known = r["author_name"] or r["author_email"]
        since = (
            {"commit": r["since_commit_sha"], "commit_date": r["since_at"][:10] if r["since_at"] else None}
            if r["since_commit_sha"]
            else {"date": r["since_date"]} if r["since_date"] else None
        )
        found.append(
            {
                "memory_id": r["memory_id"], "repository": r["repository_path"], "statement": r["statement"],
                "author": {"name": r["author_name"], "email": r["author_email"]} if known else None,
                "admitted_at": r["admitted_at"], "state": r["state"],
                "subject": {**subject, "resolution": r["subject_resolution"]}, "since": since,
                "ended_at": r["ended_at"], "end_reason": r["end_reason"], "superseded_by": r["superseded_by"],
                "supersedes": r["supersedes"],
                "citations": [{"kind": c["kind"], "ref": c["ref"], "resolution": c["resolution"]} for c in r["citations"] or []],
            }
        )
    return found


def _section(s: Session, found: ex.Evidence) -> dict | None:
    """The memories related to a unit, in force or not."""
    book, doc, spark = s.book(), found.document, s.spark
    if book.read().limit(1).count() == 0:
        return None
    names = {c["path"] for c in doc["file_changes"]}
    names |= {n for life in doc["lifecycle"] for n in [life["path"], *life["path_history"]]}
    names |= {c["old_path"] for c in doc["file_changes"] if c.get("old_path")}
    shas = [(found.unit.tip,)] if found.unit.base is None else []
    tip = s.table("commits").where(F.col("sha") == found.unit.tip).first()
    if tip is None:
        return None
    ranked = m.related(
        book.read(), book.citations(), spark.createDataFrame(shas, "sha string"),
        spark.createDataFrame([(n,) for n in sorted(names)], "path string"),
        spark.createDataFrame([(d["qualname"],) for d in doc["ast_changes"]], "qualname string"), s.root,
    )
    held = m.in_force(ranked.withColumn(REPO, F.lit(s.repo)), s.table("commits"), F.lit(tip["committed_epoch"]), F.lit(tip["committed_at"]))
    shown, left = m.section(held)
    order = ["rank", F.desc("admitted_epoch"), "memory_id"]
    shown = materialise(shown, "section")
    rows = {r["memory_id"]: r["in_force"] for r in shown.select("memory_id", "in_force").collect()}
    if not rows:
        return None
    objects = _memory_objects(s, shown, order, deep=True)
    out = {
        "in_force": [o for o in objects if rows[o["memory_id"]]],
        "not_provably_in_force": [o for o in objects if not rows[o["memory_id"]]],
    }
    omitted = left.first()["omitted"]
    return {**out, "selection": {"shown": len(rows), "omitted": omitted}} if omitted else out


def _fields(s: Session, args) -> dict:
    about = [k for k in ("path", "definition", "commit") if getattr(args, f"about_{k}")]
    if len(about) + bool(args.about_repository) > 1:
        raise MemoryError_("a memory is about one thing")
    fields = {"subject_kind": about[0] if about else "repository"}
    if about == ["path"]:
        fields["subject_path"] = _normal(args.about_path)
    elif about == ["definition"]:
        path, _, name = args.about_definition.rpartition(":")
        fields |= {"subject_path": _normal(path) or None, "subject_qualname": name}
    elif about == ["commit"]:
        fields["subject_commit_sha"] = git.resolve(s.root, args.about_commit)
    if args.since_commit:
        fields["since_commit_sha"] = git.resolve(s.root, args.since_commit)
    if args.since_date:
        fields["since_date"] = args.since_date
    name, email = git.identity(s.root)
    return {**fields, "author_name": name, "author_email": email}


def _citations(args) -> list[tuple[str, str]]:
    kinds = ("commit", "file", "definition", "range", "cochange", "absence")
    return [(kind, ref) for kind in kinds for ref in getattr(args, f"cite_{kind}") or []]


def _statement(args) -> str:
    return sys.stdin.read() if args.statement == "-" else args.statement


def memory(s: Session, args):
    book = s.opened().book()
    if args.act == "create":
        return {"memory_id": book.admit(_statement(args), _citations(args), **_fields(s, args))}
    if args.act == "supersede":
        return {"memory_id": book.supersede(args.id, _statement(args), _citations(args), **_fields(s, args))}
    if args.act == "invalidate":
        return {"memory_id": book.invalidate(args.id, args.reason)}
    if args.act == "adopt":
        return {"adopted": book.adopt(args.source)}
    if args.act == "export":
        return {"exported": book.export(args.output)}
    if args.act == "import":
        return book.take_in(args.file, args.source, dry_run=args.dry_run)
    if args.act == "show":
        one = book.find(args.id)["memory_id"]
        return _memory_objects(s, book.read().where(F.col("memory_id") == one), ["memory_id"], deep=True)[0]
    listed = m.list_memories(book.read(), s.root, include_ended=args.include_ended, limit=_limit(args))
    order = [F.desc("admitted_epoch"), F.desc("admitted_at"), "memory_id"]
    found = s.envelope(memories=_memory_objects(s, listed, order, deep=False))
    foreign = m.foreign_memories(book.read(), s.root).orderBy("repository_path").collect()
    if foreign:
        found["other_repositories"] = {
            "count": sum(r["memories"] for r in foreign), "paths": [r["repository_path"] for r in foreign],
        }
    return found


def _normal(path: str) -> str:
    path = path.replace("\\", "/")
    return path[2:] if path.startswith("./") else path


# ------------------------------------------------------------------ arguments


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gitloom", description="Ask a repository about its history.")
    commands = parser.add_subparsers(dest="command", required=True)

    def common(p):
        p.add_argument("--repo", default=".", help="a folder inside the repository")
        p.add_argument("--db", help="the store's folder")
        return p

    def limited(p):
        p.add_argument("-n", "--limit", type=int, default=20)
        p.add_argument("--all", action="store_true")
        return p

    for name, act in [("analyze", analyze), ("ast", parse)]:
        common(commands.add_parser(name)).set_defaults(act_=act)
    for name, act in [("timeline", timeline), ("hotspots", hotspots), ("files", files), ("runs", runs)]:
        limited(common(commands.add_parser(name))).set_defaults(act_=act)
    p = common(commands.add_parser("file"))
    p.add_argument("file")
    p.set_defaults(act_=file)
    p = common(commands.add_parser("commit"))
    p.add_argument("sha")
    p.set_defaults(act_=commit)
    p = limited(common(commands.add_parser("cochange")))
    p.add_argument("file")
    p.add_argument("--min-shared", type=int, default=cc.MIN_SHARED)
    p.add_argument("--large-commit-limit", type=int, default=cc.LARGE_COMMIT_LIMIT)
    p.set_defaults(act_=cochange)
    p = common(commands.add_parser("structure"))
    p.add_argument("file")
    one = p.add_mutually_exclusive_group()
    one.add_argument("--history", action="store_true")
    one.add_argument("--commit")
    p.set_defaults(act_=structure)
    p = common(commands.add_parser("explain"))
    p.add_argument("revision")
    p.add_argument("--view", action="store_true", help="print what a model is shown instead of the whole evidence")
    p.add_argument("--answer", help="a file with a model's answer, checked against the view and recorded")
    for name in ("provider", "model", "prompt"):
        p.add_argument(f"--{name}", default="", help="noted with the answer")
    p.set_defaults(act_=explain)

    acts = commands.add_parser("memory").add_subparsers(dest="act", required=True)

    def act(name, *arguments):
        p = common(acts.add_parser(name))
        for argument in arguments:
            p.add_argument(argument)
        p.set_defaults(act_=memory)
        return p

    for p in (act("create", "statement"), act("supersede", "id", "statement")):
        p.add_argument("--about-repository", action="store_true")
        for kind in ("path", "definition", "commit"):
            p.add_argument(f"--about-{kind}")
        for kind in ("commit", "file", "definition", "range", "cochange", "absence"):
            p.add_argument(f"--cite-{kind}", action="append")
        p.add_argument("--since-commit")
        p.add_argument("--since-date")
    act("invalidate", "id").add_argument("--reason", required=True)
    act("adopt").add_argument("--from", dest="source", required=True)
    act("export").add_argument("-o", "--output", required=True)
    p = act("import", "file")
    p.add_argument("--from", dest="source", required=True)
    p.add_argument("--dry-run", action="store_true")
    act("show", "id")
    limited(act("list")).add_argument("--include-ended", action="store_true")
    return parser


def run(spark: SparkSession, argv: list[str]) -> dict:
    args = _parser().parse_args(argv)
    return args.act_(Session(spark, git.repository_root(args.repo), args.db), args)


def main(argv: list[str] | None = None) -> int:
    args = sys.argv[1:] if argv is None else argv
    parsed = _parser().parse_args(args)
    spark = local_session(os.environ.get("GITLOOM_CORES", "*"))
    try:
        session = Session(spark, git.repository_root(parsed.repo), parsed.db)
        answer = parsed.act_(session, parsed)
        for note in session.notes() if parsed.command not in ("analyze",) else []:
            print(f"Note: {note}", file=sys.stderr)
    except (git.GitError, StoreError, MemoryError_, LookupError, ValueError) as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    finally:
        release(spark)
        spark.stop()
    print(json.dumps(answer, indent=2, ensure_ascii=False))
    return 0
