import collections
import hashlib

import pytest

from gitloom.llm import curriculum
from gitloom.llm.queries import QUERIES
from tests.llm.cases import docs, odd_rows, sentence, widened, words


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / total for s in open_}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def rows():
    made = [(i, sentence(i, 3 + (i * i) % 90), "en", "abcde"[min(i % 13, 4)], 1) for i in range(300)]
    return odd_rows() + made


def test_targets_and_sizes(spark):
    found = curriculum.mixed(widened(docs(spark, rows()))).collect()
    sizes = collections.Counter()
    for r in rows():
        sizes[r[3]] += len(words(r[1]))
    want, taken = plain_targets(sizes), collections.Counter()
    largest = collections.Counter()
    for r in found:
        source, size = r["_row"]["source"], len(words(r["_row"]["text"]))
        assert (r["size"], r["source_size"]) == (size, sizes[source])
        assert r["target"] == pytest.approx(want[source])
        assert 0 <= r["taken"] <= 2 * size and r["taken"] == size * len(r["positions"])
        assert all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
        taken[source] += r["taken"]
        largest[source] = max(largest[source], size)
    assert len(found) == len(rows())
    for source, target in want.items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1e-6


def test_runs_agree_however_rows_lie(spark):
    frame = docs(spark, rows())
    key = lambda f: sorted((str(r["_row"]["doc_id"]), r["size"], r["taken"], tuple(r["positions"])) for r in f.collect())
    assert key(curriculum.mixed(frame)) == key(curriculum.mixed(frame.repartition(5)))


def test_positions_follow_the_schedule(spark):
    """Half of an early source's words are asked for well before half of the training."""
    made = [(i, sentence(i, 20), "en", "abc"[i % 3], 1) for i in range(3000)]
    found = curriculum.mixed(docs(spark, made)).collect()
    for source, knots in zip("abc", curriculum.SCHEDULES):
        at = sorted(p for r in found if r["_row"]["source"] == source for p in r["positions"])
        share, demand = 0.3, 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            if t0 < share:
                t = min(share, t1)
                demand += (t - t0) * (w0 + w0 + (w1 - w0) * (t - t0) / (t1 - t0)) / 2
        assert sum(p <= share for p in at) / len(at) == pytest.approx(demand / curriculum.integral(knots), abs=0.02)


def test_training_order_repeats_whole_rows(spark):
    frame = widened(docs(spark, rows()))
    ordered = curriculum.training_order(frame)
    assert ordered.columns == frame.columns
    copies = collections.Counter((r["doc_id"], r["text"]) for r in ordered.collect())
    want = collections.Counter()
    for r in curriculum.mixed(frame).collect():
        want[(r["_row"]["doc_id"], r["_row"]["text"])] += r["copies"]
    assert copies == +want


def asked_by(t, knots):
    """The share of a schedule's words that is asked for by time *t*."""
    done = 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        x = min(max(t - t0, 0.0), t1 - t0)
        done += x * w0 + x * x * (w1 - w0) / (t1 - t0) / 2
    return done / curriculum.integral(knots)


def test_query_comes_in_training_order(spark, tmp_path):
    """Where a document stands in the query is where its source's schedule asks for it."""
    made = [(i, sentence(i, 3 + (i * i) % 90), "en", "abc"[i % 3], 1) for i in range(240)]
    docs(spark, made).write.parquet(str(tmp_path / "documents.parquet"))
    sizes = collections.Counter()
    for r in made:
        sizes[r[3]] += len(words(r[1]))
    first = {}
    for i, (source, target) in enumerate(sorted(plain_targets(sizes).items())):
        offset = 0
        for r in sorted((r for r in made if r[3] == source), key=lambda r: hashlib.md5(f"mix:{r[0]}:{r[1]}".encode()).hexdigest()):
            size, low, high = len(words(r[1])), 0.0, 1.0
            if target >= sizes[source] or offset + size / 2 <= target:
                for _ in range(50):
                    t = (low + high) / 2
                    low, high = (t, high) if asked_by(t, curriculum.SCHEDULES[i]) < (offset + size / 2) / target else (low, t)
                first[r[0]] = low
            offset += size
    got = [first.get(r["doc_id"], 2.0) for r in QUERIES["op10_curriculum_mix"](spark, str(tmp_path)).collect()]
    assert len(got) == len(made) and len(set(got)) > 100
    assert all(a <= b + 1e-9 for a, b in zip(got, got[1:]))


def test_empty_table(spark):
    assert curriculum.mixed(docs(spark, [])).count() == 0
    assert curriculum.mixed(docs(spark, [(1, None, "en", "a", 0)])).first()["taken"] == 0
