import numpy as np
import pytest

from gitloom.llm import hard_negatives as hn
from gitloom.llm.blocks import Layout
from tests.llm.cases import widened
from tests.llm.test_max_score import KIND, made, sound


def plain(rows, every=20, n_pos=5, n_neg=5, low=80):
    labels = [(i, label) for i, v, label in rows]
    usable = []
    for (i, v), label in zip(sound_all(rows), labels):
        if v is not None and label[1] is not None:
            usable.append((i, v, label[1]))
    found = set()
    for a, v, label in {(i, tuple(v), label) for i, v, label in usable if i % every == 0}:
        score = lambda w: sum(x * y for x, y in zip(v, w))
        others = [(-score(w), i, kind) for i, w, kind in usable if i != a and len(w) == len(v)]
        likes = sorted(o[:2] for o in others if o[2] == label)[:n_pos]
        for nth, (ps, p) in enumerate(likes):
            inside = sorted(o[:2] for o in others if o[2] != label and low * -ps <= 100 * -o[0] <= 100 * -ps)[:n_neg]
            found |= {(a, nth, p, r, n, -ps, -ns) for r, (ns, n) in enumerate(inside, 1)}
    return sorted((a, p, r, n, ps, ns) for a, _, p, r, n, ps, ns in found)


def sound_all(rows):
    return [(sound([r]) or [(r[0], None)])[0] for r in rows]


def mine(spark, rows, how=hn.Mining(), every=20):
    frame = widened(spark.createDataFrame(rows, KIND))
    return sorted(tuple(r) for r in hn.mined(frame, lambda key: key % every == 0, how).collect())


@pytest.mark.parametrize("scale", [0.1, 0.6, 3.0])
def test_equals_all_pairs_over_shards_and_groups(spark, scale):
    rows = made(600, 1, scale=scale)
    how = hn.Mining(references=3, first_scored=4, layout=Layout(shard_values=1500, group_values=120))
    assert mine(spark, rows, how) == plain(rows)


def test_default_mining(spark):
    rows = made(800, 2, dim=40)
    got = mine(spark, rows)
    assert got == plain(rows) and got


def test_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 8)) * 300
    points = (np.repeat(centers, 200, axis=0) + rng.normal(size=(4000, 8)) * 20).astype(np.int64)
    shard = hn.Angles(np.arange(4000), np.arange(4000) % 7, points, hn.Mining())
    anchor = shard.anchor(points[5])
    exact = points @ points[5]
    least, most = anchor.bounds(np.arange(4000))
    assert (least <= exact).all() and (exact <= most).all()
    need = int(np.sort(exact)[-50] * 0.8)
    reached = anchor.reaching(need)
    assert set(np.flatnonzero(exact >= need)) <= set(reached) and len(reached) < 2500
    assert ((most >= need) & (least <= exact.max())).sum() < 1200


def test_odd_vectors(spark):
    rows = made(60, 3, dim=4)
    rows += [(100, None, 0), (101, [], 0), (120, [], 1), (102, [0.0] * 4, 0), (140, [0.0] * 4, 0), (141, [0.0] * 4, 1)]
    rows += [(103, [1.0, None, 0.0, 2.0], 0), (104, [float("nan"), 1.0, 1.0, 1.0], 0), (105, [float("inf"), 1.0, 1.0, 1.0], 0)]
    rows += [(160, [1.0, 2.0], 0), (121, [2.0, 1.0], 0), (122, [2.0, 0.9], 1), (None, [1.0] * 4, 0), (180, [-1.0] * 4, None)]
    rows += [(200 + i, [0.5, 0.25, -1.0, 2.0], i % 2) for i in range(60)]
    assert mine(spark, rows) == plain(rows)


def test_repeated_rows_count_each_time(spark):
    rows = made(40, 4) + [(45, [1.0] * 12, 0)] * 30 + [(46, [0.99] * 12, 1)] * 30 + [(60, [1.0] * 12, 0)]
    got = mine(spark, rows, every=60)
    assert [r[:5] for r in got if r[0] == 60] == [(60, 45, r, 46, 256 * 256 * 12) for r in range(1, 6) for _ in range(5)]


def test_large_numbers(spark):
    rows = [(i, [2.0**21 + i, -(2.0**20) * (i % 3), 1.0 + i], i % 2) for i in range(50)]
    assert mine(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert mine(spark, []) == []
