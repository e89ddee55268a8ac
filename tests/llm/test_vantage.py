import numpy as np

from gitloom.llm import vantage
from tests.llm.cases import widened

KIND = "vec_id long, embedding array<float>, label int"


def made(n, seed, dim=12):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim))
    return [(i, [float(np.float32(x)) for x in centers[i % 6] + rng.normal(scale=0.6, size=dim)], 0) for i in range(n)]


def plain(rows, k):
    sound = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    found = {}
    for q, v in sound:
        if q % 20 == 0:
            scores = [(-vantage.dots(v, w[None])[0], i) for i, w in sound if i != q and len(w) == len(v)]
            found[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return found


def search(spark, rows, how):
    frame = widened(spark.createDataFrame(rows, KIND))
    got = {}
    for r in vantage.neighbours(frame, lambda key: key % 20 == 0, how).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_factor_one_is_exact_over_shards_and_blocks(spark):
    rows = made(700, 1)
    how = vantage.Search(k=10, factor=1.0, leaf=16, shard_rows=200, block_rows=10)
    assert search(spark, rows, how) == plain(rows, 10)


def test_relaxed_search_recalls(spark):
    rows = made(2000, 2)
    want = plain(rows, 20)
    got = search(spark, rows, vantage.Search(leaf=32))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_odd_vectors(spark):
    rows = made(60, 3, dim=4)
    rows += [(100, None, 0), (101, [], 0), (102, [0.0] * 4, 0), (103, [1.0, None, 0.0, 2.0], 0), (104, [float("nan"), 1.0, 1.0, 1.0], 0)]
    rows += [(105, [float("inf"), 1.0, 1.0, 1.0], 0), (120, [1.0, 2.0], 0), (121, [2.0, 1.0], 0), (None, [1.0] * 4, 0)]
    rows += [(200 + i, [0.5, 0.25, -1.0, 2.0], 0) for i in range(60)]
    assert search(spark, rows, vantage.Search(factor=1.0, leaf=8)) == plain(rows, 20)


def test_empty_table(spark):
    assert search(spark, [], vantage.Search()) == {}
