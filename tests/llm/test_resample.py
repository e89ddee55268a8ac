import hashlib
import math
import random
import re
import zlib

import pytest

from gitloom.llm import resample
from tests.llm.cases import docs, lowered, odd_rows, sentence, widened


def features(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return found, [" ".join(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)]


def plain(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[bucket(f)] += 1
    ss, tt = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (ss + 10000) / ((a + 1) * (tt + 10000)))) for a, b in zip(s, t)]
    out = []
    for doc_id, text, *_ in rows:
        found, runs = features(text)
        weight = sum(gain[bucket(f)] for f in runs)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), len(runs), weight, score, None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: 5 * len(able) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, out), key=repr)


def target(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def drawn(spark, rows, aims, how=resample.Draw()):
    found = resample.resampled(widened(docs(spark, rows)), target(spark, aims), how)
    return sorted((tuple(r) for r in found.collect()), key=repr)


AIMS = [sentence(3, 60), sentence(11, 30), None, "", "River STONE, 漢字-river"]


def many(n):
    return [(1000 + i, sentence(i % 150, 5 + i % 60), "en", "a", 1) for i in range(n)]


def test_equals_a_plain_draw(spark):
    rows = odd_rows() + many(700)
    got = drawn(spark, rows, AIMS, resample.Draw(pivots=3))
    assert got == plain(rows, AIMS)
    assert sum(r[5] is not None for r in got) > 20


def test_cut_texts_have_the_same_features(spark):
    rows = odd_rows()
    assert drawn(spark, rows, AIMS, resample.Draw(piece=7)) == drawn(spark, rows, AIMS)


@pytest.mark.parametrize("text", ["", "a", "a b", "a b c", "Ä b, c-d  e\x00f  g", "x" * 50, " . "])
@pytest.mark.parametrize("piece", [1, 3, 1000])
def test_features_of_short_texts(text, piece):
    found, n = resample.hashed(text.encode(), 10000, piece)
    words, runs = features(text)
    assert n == len(words) and sorted(found) == sorted(zlib.crc32(f.encode()) % 10000 for f in runs)


@pytest.mark.parametrize("pivots", [1, 4, 31])
def test_quickselect_finds_every_place(spark, pivots):
    dice = random.Random(pivots)
    rows = [(dice.choice([None, 1, 2, 3, 40]), 30, 5, 1, dice.randint(-3, 3), i) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long, row long")
    keyed = resample._keyed(frame).cache()
    order = sorted((-r[4], int(r[0] is None), r[0] or 0, r[5]) for r in rows)
    for k in (1, 2, 17, 59, 60):
        assert resample.kth_key(keyed, k, pivots, 7) == order[k - 1]
    assert resample.kth_key(keyed, 61, pivots, 7) is None


def test_repeated_rows_share_the_draw(spark):
    """Half of all rows are one row, whose key the last place falls on."""
    rows = [(7, sentence(3, 60), "en", "a", 1)] * 300 + many(300)
    aims = [sentence(3, 60)] * 1000
    got = drawn(spark, rows, aims)
    assert got == plain(rows, aims)
    assert {r[0] for r in got if r[5] is not None} == {7}


def test_few_and_no_rows(spark):
    assert all(r[5] is None for r in drawn(spark, odd_rows(), AIMS))
    assert drawn(spark, [], AIMS) == []
    assert drawn(spark, odd_rows(), []) == plain(odd_rows(), [])
