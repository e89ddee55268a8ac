import pytest
from pyspark.sql import functions as F

from gitloom import ingest
from gitloom.functions import text
from gitloom.operators import history as h
from gitloom.operators import lifecycle as lc
from gitloom.operators import structure as st
from gitloom.operators import sync
from gitloom.session import materialise
from gitloom.sources import git
from gitloom.sources.store import Store, StoreError
from tests.gitrepo import Repo

LOGIN = "def login(user):\n    return user\n\n\ndef helper():\n    return 1\n"


@pytest.fixture(scope="module")
def sample(tmp_path_factory):
    repo = Repo(tmp_path_factory.mktemp("sample"))
    long = "".join(f"line {i}\n" for i in range(20))
    shas = [
        repo.commit("Initial commit\n\nbody", {"README.md": "a\n", "app.py": LOGIN + f"# {long!r}\n", "legacy.py": "x = 1\n"}),
        repo.commit("Move app", move=[("app.py", "core/app.py")]),
    ]
    repo.git("checkout", "-q", "-b", "side")
    shas.append(repo.commit("Add caching", {"core/cache.py": "class Cache:\n    def get(self):\n        pass\n"}))
    repo.git("checkout", "-q", "main")
    shas.append(repo.commit("Fix login", {"core/app.py": LOGIN.replace("return user", "return user.name") + f"# {long!r}\n"}))
    repo.clock += 86_400
    repo.git("merge", "-q", "--no-ff", "-m", "Merge", "side")
    shas.append(repo.git("rev-parse", "HEAD"))
    shas.append(repo.commit("Add logo, drop legacy", {"logo.png": b"\x89PNG\0\1", "工具/文 本.py": "y = (\n"}, remove=["legacy.py"]))
    return repo, shas


@pytest.fixture(scope="module")
def analysed(spark, sample, tmp_path_factory):
    repo, shas = sample
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    totals = ingest.analyze(spark, store, {"sample": repo.path}).collect()
    tallies = ingest.parse(spark, store, {"sample": repo.path}).collect()
    return store, totals, tallies


def test_history_comes_in_whole(spark, sample, analysed):
    repo, shas = sample
    store, totals, _ = analysed
    assert (totals[0]["commits"], totals[0]["file_changes"]) == (6, 9)
    timeline = h.timeline(store.read("commits"), store.read("commit_files"), limit=None).collect()
    assert [r["sha"] for r in timeline] == shas[::-1]
    assert [r["files_changed"] for r in timeline] == [3, 0, 1, 1, 1, 3]
    assert timeline[-1]["message"] == "Initial commit"
    files = {(r["path"]): r for r in store.read("commit_files").where("change_type in ('R', 'A')").collect()}
    assert files["core/app.py"]["old_path"] == "app.py" and files["core/app.py"]["similarity"] == 100
    assert files["logo.png"]["added_lines"] is None
    assert "工具/文 本.py" in files
    assert [r["commit_sha"] for r in h.merges(store.read("commit_parents")).collect()] == [shas[4]]
    assert store.violations().count() == 0


@pytest.mark.parametrize("size", [1, 2])
def test_slices_give_the_same_history(spark, sample, size):
    repo, _ = sample
    repos = git.repositories(spark, {"sample": repo.path})
    whole, cut = git.read_history(repos), git.read_history(repos, size=size)
    for name in ("commits", "commit_parents", "commit_files"):
        assert sorted(map(str, whole[name].collect())) == sorted(map(str, cut[name].collect()))
    between = git.read_history(repos, "HEAD~2..HEAD")["commits"]
    assert between.count() == 3


def test_lives_of_the_sample(spark, analysed):
    store, _, _ = analysed
    lives = sync.stored_lives(*[store.read(t) for t in ("commits", "commit_files", "commit_parents")])
    stats = {r["current_path"]: r for r in lc.file_statistics(lives.frame).collect()}
    assert len(stats) == 6
    assert stats["core/app.py"]["commits"] == 3 and stats["core/app.py"]["renames"] == 1
    assert stats["legacy.py"]["is_deleted"]


def test_definitions_and_blind_spots(spark, sample, analysed):
    _, shas = sample
    store, _, tallies = analysed
    assert (tallies[0]["file_versions"], tallies[0]["failed"]) == (6, 1)
    lives = sync.stored_lives(*[store.read(t) for t in ("commits", "commit_files", "commit_parents")])
    found = st.definition_history(lives, store.read("file_versions"), store.read("definition_versions"))
    events = {(r["path"], r["qualname"], r["change"], r["commit_sha"]) for r in found.events.collect()}
    assert ("app.py", "login", "created", shas[0]) in events
    assert ("core/app.py", "login", "modified", shas[3]) in events
    assert ("core/cache.py", "Cache.get", "created", shas[2]) in events
    assert not [e for e in events if e[1] == "helper" and e[2] != "created"]
    words = store.read("definition_versions").where(F.col("commit_sha") == shas[3]).collect()
    assert {r["qualname"]: r["change_type"] for r in words} == {"login": "modified", "helper": "unchanged"}


def test_a_second_pass_parses_nothing(spark, sample, analysed):
    repo, _ = sample
    store, _, _ = analysed
    before = sorted(map(str, store.read("definition_versions").collect()))
    again = ingest.parse(spark, store, {"sample": repo.path}).collect()[0]
    assert (again["contents_to_parse"], again["reused"], again["changes"]) == (0, 6, 0)
    assert sorted(map(str, store.read("definition_versions").collect())) == before


def test_a_rewrite_takes_its_rows_with_it(spark, tmp_path):
    repo = Repo(tmp_path / "r") if (tmp_path / "r").mkdir() is None else None
    repo.commit("one", {"a.py": "def a(): pass\n"})
    keep = repo.commit("two", {"b.py": "def b(): pass\n"})
    repo.commit("three", {"c.py": "def c(): pass\n"})
    store = Store(spark, str(tmp_path / "store"))
    ingest.analyze(spark, store, {"r": repo.path})
    ingest.parse(spark, store, {"r": repo.path})
    repo.git("reset", "-q", "--hard", keep)
    new = repo.commit("another", {"d.py": "def d(): pass\n"})
    ingest.analyze(spark, store, {"r": repo.path})
    assert store.read("commits").count() == 3
    assert store.meta("head_sha:r") == new
    assert {r["path"] for r in store.read("file_versions").collect()} == {"a.py", "b.py"}


def test_a_second_pass_writes_what_is_new(spark, tmp_path):
    """One commit more adds its own rows; files that were there are not touched, unless a stored row was wrong."""
    (tmp_path / "r").mkdir()
    repo = Repo(tmp_path / "r")
    for i in range(4):
        repo.commit(f"c{i}", {"a.py": "".join(f"def f{k}():\n    return {i}\n" for k in range(5)), f"b{i}.py": "x = 1\n"})
    store = Store(spark, str(tmp_path / "store"))
    files = lambda: {p for t in ("file_versions", "definition_versions") for p in store.read(t).inputFiles()}

    def passes():
        ingest.analyze(spark, store, {"r": repo.path})
        return ingest.parse(spark, store, {"r": repo.path}).first()["changes"]

    assert passes() == 8 + 20
    before = files()
    repo.commit("one more", {"b1.py": "def g():\n    pass\n"})
    assert passes() == 2
    assert before < files()
    held = {t: sorted(map(str, store.read(t).collect())) for t in ("file_versions", "definition_versions")}
    wrong = store.read("file_versions").withColumn("content_sha", F.when(F.col("path") != "a.py", F.col("content_sha")).otherwise("0"))
    store.replace_repositories("file_versions", materialise(wrong, "wrong"))
    assert passes() == 4
    assert {t: sorted(map(str, store.read(t).collect())) for t in held} == held
    with pytest.raises(StoreError):
        store.require("/elsewhere")


def test_only_new_commits_are_read(spark, tmp_path):
    (tmp_path / "r").mkdir()
    repo = Repo(tmp_path / "r")
    repo.commit("one", {"a.py": "def a(): pass\n"})
    old = repo.commit("two", {"b.py": "def b(): pass\n"})
    store = Store(spark, str(tmp_path / "store"))
    ingest.analyze(spark, store, {"r": repo.path})
    ingest.analyze(spark, store, {"r": repo.path})
    new = repo.commit("three", {"a.py": "def a(): return 1\n"})
    repos = git.repositories(spark, {"r": repo.path}).withColumn("since", F.lit(old))
    assert [r["sha"] for r in git.read_history(repos)["commits"].collect()] == [new]
    ingest.analyze(spark, store, {"r": repo.path})
    assert store.meta("head_sha:r") == new
    assert (store.read("commits").count(), store.read("commit_files").count()) == (3, 3)
    assert store.violations().count() == 0


def test_patches_and_ranges(spark, sample):
    repo, shas = sample
    repos = git.repositories(spark, {"sample": repo.path})
    units = repos.crossJoin(spark.createDataFrame([(s,) for s in shas], "unit string"))
    patches = git.commit_patches(units).select(
        "unit", text.section_path(F.col("section")).alias("path"), text.new_side_ranges(F.col("section")).alias("r")
    ).collect()
    by_unit = {(r["unit"], r["path"]): [(x["start"], x["end"]) for x in r["r"]] for r in patches}
    assert by_unit[(shas[3], "core/app.py")] == [(2, 2)]
    assert by_unit[(shas[1], "core/app.py")] == []
    assert not [k for k in by_unit if k[0] == shas[4]]
    ends = repos.withColumn("unit", F.lit("u")).withColumn("base", F.lit(shas[0])).withColumn("tip", F.lit(shas[5]))
    net = {r["path"]: r["net_status"][0] for r in git.range_net_changes(ends).collect()}
    assert net == {"core/app.py": "R", "core/cache.py": "A", "logo.png": "A", "legacy.py": "D", "工具/文 本.py": "A"}
    named = {r[0] for r in git.range_patches(ends).select(text.section_path(F.col("section"))).collect()}
    assert {"core/app.py", "core/cache.py", "legacy.py"} <= named


def test_blobs_are_read_by_name(spark, sample):
    repo, shas = sample
    refs = spark.createDataFrame(
        [("sample", repo.path, shas[0], "README.md"), ("sample", repo.path, shas[0], "no.py")],
        "repo_id string, root string, commit_sha string, path string",
    )
    found = {r["path"]: r for r in git.read_blobs(refs).collect()}
    assert bytes(found["README.md"]["content"]) == b"a\n" and found["README.md"]["object_kind"] == "blob"
    assert found["no.py"]["content_sha"] is None
