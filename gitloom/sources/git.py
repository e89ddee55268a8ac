"""Reading repositories with git, from Spark tasks.

A repository is never read by one task: its history is cut into slices of
commits, its versions and patches into partitions of objects, and every task runs
git on its own share, streaming the output.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gitloom.functions.pysource import DEFINITIONS, PRODUCER, read_definitions
from gitloom.operators.lifecycle import REPO
from gitloom.session import materialise, pieces

SLICE = 2_000
ROWS = 5_000
PYTHON_SUFFIX = ".py"

# The object git compares a root commit with, and the flags that
# keep its output the same on every machine.
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
PINNED = ["--no-color", "--no-ext-diff", "--no-textconv"]
PATCH = [*PINNED, "--find-renames=50%", "--full-index", "--src-prefix=a/", "--dst-prefix=b/"]
HEADER = "%x1e%H%x1f%P%x1f%an%x1f%ae%x1f%aI%x1f%cI%x1f%ct%x1f%B%x00"


class GitError(RuntimeError):
    """git refused; the message is its own."""


def _command(root: str, *arguments: str) -> list[str]:
    return ["git", "--no-pager", "-C", root, "-c", "core.quotePath=false", *arguments]


def git(root: str, *arguments: str) -> str:
    """A small answer, whole."""
    done = subprocess.run(_command(root, *arguments), capture_output=True)
    if done.returncode:
        raise GitError(_text(done.stderr).strip())
    return _text(done.stdout).strip()


def _stream(root: str, *arguments: str) -> Iterator[bytes]:
    """A large answer in pieces."""
    with subprocess.Popen(_command(root, *arguments), stdout=subprocess.PIPE, stderr=subprocess.PIPE) as run:
        yield from iter(lambda: run.stdout.read(1 << 20), b"")
        refused = run.stderr.read()
    if run.returncode:
        raise GitError(_text(refused).strip())


def _split(pieces: Iterable[bytes], mark: bytes) -> Iterator[bytes]:
    rest = b""
    for piece in pieces:
        *whole, rest = (rest + piece).split(mark)
        yield from whole
    if rest:
        yield rest


def _text(raw: bytes) -> str:
    """UTF-8; other bytes are written out, so different names stay different."""
    return raw.decode("utf-8", errors="backslashreplace")


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([row.get(c) for row in rows], dtype=object) for c in columns})


def _batches(rows: Iterable[dict], columns: list[str], size: int = ROWS) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _frame(held, columns)
            held = []
    if held:
        yield _frame(held, columns)


def _mapped(frame: DataFrame, rows, schema: str) -> DataFrame:
    """One call of *rows* per input row, its answers streamed out."""
    columns = [field.split()[0] for field in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for item in batch.to_dict("records"):
                yield from _batches(rows(item), columns)

    return frame.mapInPandas(run, schema)


# ------------------------------------------------------------------ probes


def repository_root(path: str) -> str:
    return git(path, "rev-parse", "--show-toplevel")


def head_sha(root: str) -> str:
    return git(root, "rev-parse", "--verify", "HEAD")


def is_shallow(root: str) -> bool:
    return git(root, "rev-parse", "--is-shallow-repository") == "true"


def identity(root: str) -> tuple[str | None, str | None]:
    def configured(key: str) -> str | None:
        try:
            return git(root, "config", "--get", key) or None
        except GitError:
            return None

    return configured("user.name"), configured("user.email")


def resolve(root: str, revision: str) -> str:
    try:
        return git(root, "rev-parse", "--verify", "--end-of-options", f"{revision}^{{commit}}")
    except GitError as error:
        raise GitError(f"{revision}: {error}") from None


def resolve_range(root: str, text: str) -> tuple[str, str]:
    base, dots, tip = text.partition("..")
    if not dots or not base or not tip or ".." in tip or tip.startswith("."):
        raise ValueError(f"{text!r} is not a range; write base..tip")
    return resolve(root, base), resolve(root, tip)


def repositories(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(repo_id, root). Roots have to be readable from every executor."""
    return spark.createDataFrame(list(roots.items()), f"{REPO} string, root string")


# ------------------------------------------------------------------ history


def history_slices(repos: DataFrame, revision: str = "HEAD", size: int = SLICE) -> DataFrame:
    """Each history in slices of *size* commits, counted by the tasks themselves.

    *revision* may be a range. Repositories that carry ``since`` (a commit already
    held) are read from there, unless a rewrite took it out of the history;
    ``whole`` says which it was. The tip is pinned, so the slices of one read fit
    together even when somebody commits meanwhile.
    """
    if "since" not in repos.columns:
        repos = repos.withColumn("since", F.lit(None).cast("string"))

    def probe(item: dict) -> Iterator[dict]:
        root, since = item["root"], item["since"]
        if ".." in revision:
            tip, whole = None, True
            wanted = "..".join(resolve_range(root, revision))
        else:
            tip = wanted = resolve(root, revision)
            whole = since is None or not _is_ancestor(root, since, tip)
            if not whole:
                wanted = f"{since}..{tip}"
        n = int(git(root, "rev-list", "--count", wanted))
        yield {**item, "revision": wanted, "tip": tip, "whole": whole, "n": n}

    schema = f"{REPO} string, root string, revision string, tip string, whole boolean, n bigint"
    found = materialise(_mapped(repos, probe, schema), "probed")
    last = F.greatest(F.floor((F.col("n") - 1) / size), F.lit(0))
    cut = found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    slices = cut.withColumn("skip", F.col("k") * size).withColumn("take", F.lit(size))
    return slices.repartition(pieces(cut, 1), REPO, "k")


def _is_ancestor(root: str, older: str, newer: str) -> bool:
    try:
        git(root, "merge-base", "--is-ancestor", older, newer)
    except GitError:
        return False
    return True


ENTRY = (
    f"{REPO} string, sha string, section string, ordinal bigint, parents string, author_name string,"
    " author_email string, authored_at string, committed_at string, committed_epoch bigint,"
    " message string, path string, old_path string, change_type string, similarity int,"
    " added_lines bigint, deleted_lines bigint, mode string, blob_sha string"
)


def _log_entries(item: dict) -> Iterator[dict]:
    """The commits, changed files and line counts of one slice, one row each."""
    if not item["n"]:
        return
    arguments = [
        "log", "--raw", "--numstat", "-M", "-z", "--no-abbrev", "--topo-order", f"--format={HEADER}",
        f"--skip={item['skip']}", f"--max-count={item['take']}", item["revision"],
    ]
    tokens = _split(_stream(item["root"], *arguments), b"\0")
    at, ordinal = None, item["skip"] - 1
    for token in tokens:
        token = token.lstrip(b"\n")
        if not token:
            continue
        if token.startswith(b"\x1e"):
            sha, parents, *who, epoch, message = _text(token[1:]).split("\x1f", 7)
            names = ("author_name", "author_email", "authored_at", "committed_at")
            ordinal += 1
            at = {REPO: item[REPO], "sha": sha}
            yield {
                **at, "section": "commit", "ordinal": ordinal, "parents": parents, **dict(zip(names, who)),
                "committed_epoch": int(epoch), "message": message.rstrip("\n"),
            }
        elif token.startswith(b":"):
            _, mode, _, blob, status = token[1:].decode("ascii").split(" ")
            moved = status[0] in "RC"
            old = _text(next(tokens)) if moved else None
            yield {
                **at, "section": "raw", "old_path": old, "path": _text(next(tokens)), "change_type": status[0],
                "similarity": int(status[1:]) if moved and status[1:] else None, "mode": mode, "blob_sha": blob,
            }
        else:
            added, deleted, path = token.split(b"\t", 2)
            old = None
            if not path:
                old, path = _text(next(tokens)), next(tokens)
            yield {
                **at, "section": "numstat", "old_path": old, "path": _text(path),
                "added_lines": None if added == b"-" else int(added),
                "deleted_lines": None if deleted == b"-" else int(deleted),
            }


def _offset(column: str) -> Column:
    """git writes Z for an offset of zero; keep one spelling."""
    return F.regexp_replace(column, "Z$", "+00:00").alias(column)


def read_history(repos: DataFrame, revision: str = "HEAD", size: int = SLICE) -> dict[str, DataFrame]:
    """commits (with ``ordinal``, newest first), commit_parents, commit_files, and
    ``read``: the tip of each repository and whether its whole history came."""
    slices = history_slices(repos, revision, size)
    entries = materialise(_mapped(slices, _log_entries, ENTRY), "log")
    commits = entries.where("section = 'commit'")
    return {
        "read": slices.where("k = 0").select(REPO, "tip", "whole", "n"),
        "commits": commits.select(
            REPO, "sha", "author_name", "author_email", *[_offset(c) for c in ("authored_at", "committed_at")],
            "committed_epoch", "message", "ordinal",
        ),
        "commit_parents": commits.where("parents <> ''").select(
            REPO,
            F.col("sha").alias("commit_sha"),
            F.posexplode(F.split("parents", " ")).alias("position", "parent_sha"),
        ),
        "commit_files": changed_files(entries),
    }


def changed_files(entries: DataFrame) -> DataFrame:
    """Put the two listings of a commit together; each file has to be in both, once."""
    once = "each changed file has one raw and one numstat line: "
    raw = F.count(F.when(F.col("section") == "raw", 1))
    counted = F.count(F.when(F.col("section") == "numstat", 1))
    named = F.concat(F.lit(once), "sha", F.lit(" "), "path")
    return (
        entries.where("section <> 'commit'")
        .groupBy(REPO, "sha", "path", "old_path")
        .agg(
            F.max("change_type").alias("letter"),
            F.max("similarity").alias("similarity"),
            F.max("mode").alias("mode"),
            F.max("blob_sha").alias("blob_sha"),
            F.max("added_lines").alias("added_lines"),
            F.max("deleted_lines").alias("deleted_lines"),
            raw.alias("_raw"),
            counted.alias("_counted"),
        )
        .select(
            REPO,
            F.col("sha").alias("commit_sha"),
            "path",
            "old_path",
            F.when((F.col("_raw") == 1) & (F.col("_counted") == 1), F.col("letter"))
            .otherwise(F.raise_error(named))
            .alias("change_type"),
            "added_lines",
            "deleted_lines",
            "similarity",
            "mode",
            "blob_sha",
        )
    )


# ------------------------------------------------------------------ objects


class _Objects:
    """One ``git cat-file --batch`` per repository, asked one object at a time."""

    def __init__(self, root: str):
        self._run = subprocess.Popen(
            _command(root, "cat-file", "--batch"), stdin=subprocess.PIPE, stdout=subprocess.PIPE
        )

    def read(self, name: str) -> tuple[str, str, bytes] | None:
        """(sha, kind, bytes), or None when git does not hold it."""
        if "\n" in name:
            raise ValueError("an object name is one line")
        self._run.stdin.write(name.encode("utf-8") + b"\n")
        self._run.stdin.flush()
        head = self._run.stdout.readline()
        if head.endswith((b" missing\n", b" ambiguous\n")):
            return None
        sha, kind, size = head.decode("ascii").split()
        body = self._run.stdout.read(int(size) + 1)
        if len(body) != int(size) + 1:
            raise GitError(f"git stopped inside {name}")
        return sha, kind, body[:-1]

    def close(self) -> None:
        self._run.stdin.close()
        self._run.stdout.close()
        self._run.wait()


def _asked(frame: DataFrame, keys: list[str], answer, schema: str) -> DataFrame:
    """*answer(objects, row)* for every row, one process per repository and task."""
    columns = [field.split()[0] for field in schema.split(", ")]

    def run(batches):
        root, objects = None, None

        def answers(batch):
            nonlocal root, objects
            for item in batch.to_dict("records"):
                if item["root"] != root:
                    if objects:
                        objects.close()
                    root, objects = item["root"], _Objects(item["root"])
                yield answer(objects, item)

        try:
            for batch in batches:
                yield from _batches(answers(batch), columns, 200)
        finally:
            if objects:
                objects.close()

    keyed = frame.repartition(pieces(frame, 200), *keys)
    return keyed.sortWithinPartitions("root").mapInPandas(run, schema)


def read_blobs(refs: DataFrame) -> DataFrame:
    """(repo_id, root, commit_sha, path) → the object there: its sha, kind and bytes."""

    def answer(objects: _Objects, item: dict) -> dict:
        found = objects.read(f"{item['commit_sha']}:{item['path']}")
        sha, kind, body = found or (None, None, None)
        return {**item, "content_sha": sha, "object_kind": kind, "content": body}

    return _asked(
        refs.select(REPO, "root", "commit_sha", "path"),
        [REPO, "commit_sha", "path"],
        answer,
        f"{REPO} string, root string, commit_sha string, path string, content_sha string,"
        " object_kind string, content binary",
    )


PARSED = (
    f"{REPO} string, content_sha string, parsed_at_version string, definitions {DEFINITIONS},"
    " parse_error string, error_lineno int, error_offset int"
)


def parse_contents(contents: DataFrame) -> DataFrame:
    """(repo_id, root, content_sha), each once → its definitions, or why it has none.

    The bytes stay inside the task that read them.
    """

    def answer(objects: _Objects, item: dict) -> dict:
        found = objects.read(item["content_sha"])
        parsed = read_definitions(found[2]) if found else {"parse_error": "missing: git does not hold it"}
        return {REPO: item[REPO], "content_sha": item["content_sha"], "parsed_at_version": PRODUCER, **parsed}

    return _asked(contents.select(REPO, "root", "content_sha"), [REPO, "content_sha"], answer, PARSED)


# ------------------------------------------------------------------ patches


SECTION = f"{REPO} string, unit string, section string"


def _sections(item: dict, arguments: list[str]) -> Iterator[dict]:
    held: list[bytes] = []

    def row() -> dict:
        return {REPO: item[REPO], "unit": item["unit"], "section": _text(b"".join(held))}

    for line in _split(_stream(item["root"], *arguments), b"\n"):
        if line.startswith(b"diff --git ") and held:
            yield row()
            held.clear()
        if held or line.startswith(b"diff --git "):
            held.append(line + b"\n")
    if held:
        yield row()


def commit_patches(units: DataFrame, context_lines: int = 0) -> DataFrame:
    """(repo_id, root, unit = sha) → one row per file of the commit's patch. None for a merge."""
    tail = [] if context_lines == 0 else PATCH[len(PINNED) :]

    def rows(item: dict) -> Iterator[dict]:
        flags = ["show", "--format=", f"--unified={context_lines}", *PINNED, *tail, item["unit"]]
        merge = len(git(item["root"], "rev-list", "--parents", "-n", "1", item["unit"]).split()) > 2
        return iter(()) if merge else _sections(item, flags)

    keyed = units.select(REPO, "root", "unit").repartition(pieces(units, 50), REPO, "unit")
    return _mapped(keyed, rows, SECTION)


def range_patches(ranges: DataFrame, context_lines: int = 3) -> DataFrame:
    """(repo_id, root, unit, base, tip) → one row per file that differs between the endpoints."""

    def rows(item: dict) -> Iterator[dict]:
        flags = ["diff", f"--unified={context_lines}", *PATCH, item["base"], item["tip"]]
        return _sections(item, flags)

    return _mapped(ranges.select(REPO, "root", "unit", "base", "tip"), rows, SECTION)


def range_net_changes(ranges: DataFrame) -> DataFrame:
    """(repo_id, unit, path) → how the endpoints differ, with both blobs."""

    def rows(item: dict) -> Iterator[dict]:
        flags = ["diff", "--raw", "-z", "--no-abbrev", *PINNED, "--find-renames=50%", item["base"], item["tip"]]
        tokens = _split(_stream(item["root"], *flags), b"\0")
        for token in tokens:
            if not token:
                continue
            _, _, old_blob, new_blob, status = token[1:].decode("ascii").split(" ")
            old = _text(next(tokens)) if status[0] in "RC" else None
            yield {
                REPO: item[REPO], "unit": item["unit"], "path": _text(next(tokens)), "old_path": old,
                "net_status": status, "old_blob": old_blob, "new_blob": new_blob,
            }

    return _mapped(
        ranges.select(REPO, "root", "unit", "base", "tip"),
        rows,
        f"{REPO} string, unit string, path string, old_path string, net_status string,"
        " old_blob string, new_blob string",
    )
