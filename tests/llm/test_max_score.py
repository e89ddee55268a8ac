import math

import numpy as np
import pytest

from gitloom.llm import max_score
from gitloom.llm.blocks import Layout
from tests.llm.cases import widened

KIND = "vec_id long, embedding array<double>, label int"


def made(n, seed, dim=12, scale=0.6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim))
    return [(i, [float(x) for x in centers[i % 6] + rng.normal(scale=scale, size=dim)], i % 4) for i in range(n)]


def sound(rows):
    """(id, whole numbers) of the rows that take part."""
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    return [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and good(v)]


def plain(rows, k, every):
    usable = sound(rows)
    found = {}
    for q, v in {(i, tuple(v)) for i, v in usable if i % every == 0}:
        scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v)]
        found.setdefault(q, []).append([(i, -s) for s, i in sorted(scores)[:k]])
    return {q: sorted(lists) for q, lists in found.items() if any(lists)}


def search(spark, rows, how, every=20):
    frame = widened(spark.createDataFrame(rows, KIND))
    got = {}
    for r in max_score.top(frame, lambda key: key % every == 0, how).orderBy("query_id", "rank", "score").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [[(i, s) for _, i, s in lists]] for q, lists in got.items()}


@pytest.mark.parametrize("scale", [0.1, 0.6, 3.0])
def test_equals_all_pairs_over_shards_and_groups(spark, scale):
    rows = made(700, 1, scale=scale)
    how = max_score.Search(k=7, heads=4, seeds=3, step=2, layout=Layout(shard_values=2000, group_values=150))
    assert search(spark, rows, how) == plain(rows, 7, 20)


def test_default_search(spark):
    rows = made(900, 2, dim=40)
    assert search(spark, rows, max_score.Search(), 50) == plain(rows, 5, 50)


def test_bounds_leave_rows_out():
    """Where a few terms carry the score, most rows are never scored whole."""
    rng = np.random.default_rng(5)
    points = rng.integers(0, 3, size=(4000, 30))
    points[rng.random(points.shape) < 0.8] = 0
    points[:40, 3] = 200
    index = max_score.Postings(np.arange(4000), points, max_score.Search())
    query = np.ones(30, np.int64)
    sign, bound = np.zeros(30, int), index.most[0]
    rows, scores = index._competitive(query.astype(float), sign, bound, -1)
    assert len(rows) < 100
    want = sorted((-int(s), i) for i, s in enumerate(points @ query))[:5]
    ids, best = index.best(-1, query)
    assert [(-s, i) for i, s in zip(ids, best)] == want


def test_odd_vectors(spark):
    rows = made(60, 3, dim=4)
    rows += [(100, None, 0), (101, [], 0), (120, [], 0), (102, [0.0] * 4, 0), (140, [0.0] * 4, 0)]
    rows += [(103, [1.0, None, 0.0, 2.0], 0), (104, [float("nan"), 1.0, 1.0, 1.0], 0), (105, [float("inf"), 1.0, 1.0, 1.0], 0)]
    rows += [(160, [1.0, 2.0], 0), (121, [2.0, 1.0], 0), (None, [1.0] * 4, 0), (180, [-1.0, -1.0, -1.0, -1.0], None)]
    rows += [(200 + i, [0.5, 0.25, -1.0, 2.0], 0) for i in range(60)] + [(220, [0.5, 0.25, -1.0, 2.0], 9)] * 40
    assert search(spark, rows, max_score.Search()) == plain(rows, 5, 20)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [2.0**21 + i, -(2.0**20) * (i % 3), 1.0 + i], 0) for i in range(50)]
    assert search(spark, rows, max_score.Search()) == plain(rows, 5, 20)
    # Beyond a long, components and scores stop at its ends.
    rows = [(i, [1e300, 1.0], 0) for i in range(3)]
    assert search(spark, rows, max_score.Search())[0] == [[(1, (1 << 63) - 1), (2, (1 << 63) - 1)]]


def test_queries_of_one_id_are_answered_apart(spark):
    rows = made(50, 4) + [(20, [1.0] * 12, 0), (20, [1.0] * 12, 1)]
    frame = spark.createDataFrame(rows, KIND)
    got = max_score.top(frame, lambda key: key == 20).collect()
    assert sorted(r["rank"] for r in got) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    want = {(i, s) for lists in plain(rows, 5, 20)[20] for i, s in lists}
    assert {(r["vec_id"], r["score"]) for r in got} == want


def test_empty_table(spark):
    assert search(spark, [], max_score.Search()) == {}
