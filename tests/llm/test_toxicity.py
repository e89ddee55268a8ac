import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gitloom.llm import toxicity
from gitloom.llm.common import crc_remainder
from tests.llm.cases import docs, odd_rows, sentence, widened


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=24))
def test_segments_are_all_maximal_ones(values):
    """By definition: best segment of the rest, again and again, as Ruzzo and Tompa define it."""
    scores = np.array(values, dtype=float)

    def split(a, b):
        best = None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                s = scores[i:j].sum()
                if s > 0 and (best is None or s > best[0] or (s == best[0] and j - i < best[2] - best[1])):
                    best = (s, i, j)
        return [] if best is None else split(a, best[1]) + [best] + split(best[2], b)

    got = toxicity.segments(scores)
    want = split(0, len(scores))
    assert math.isclose(sum(g[2] for g in got), sum(w[0] for w in want))
    assert sorted(round(g[2], 6) for g in got) == sorted(round(w[0], 6) for w in want)
    for first, end, score in got:
        assert math.isclose(scores[first:end].sum(), score)


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text, toxic = sentence(rng.randrange(400), rng.randrange(30, 120)).split(), int(rng.random() < 0.2)
        if toxic:
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(("vilegrub", "scumlout", "hatewort")) + rng.choice(("", "er", "ing", "s")) for _ in range(4)]
        rows.append((i, " ".join(text), "en", "a", 1))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy_and_passages(spark):
    rows, labels = corpus(600, 5)
    told = spark.createDataFrame(labels + [(5, 1, None), (99999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    held = crc_remainder(F.col("doc_id"), 4) == 2
    frame = widened(docs(spark, rows))
    model = toxicity.learned(frame, told, ~held)
    truth = {i: t for i, _, t in labels}
    found = toxicity.scored(frame, model).withColumn("held", F.pmod(F.crc32(F.col("_row.doc_id").cast("string").cast("binary")), F.lit(4)) == 2)
    right = [(r["score"] >= 0.3) == bool(truth[r["_row"]["doc_id"]]) for r in found.collect() if r["held"]]
    assert len(right) > 80 and np.mean(right) > 0.95
    for r in found.filter("score > 0.9").collect():
        text = r["_row"]["text"].split()
        assert any(w.startswith(("vilegrub", "scumlout", "hatewort")) for p in r["passages"] for w in text[p["first_word"] : p["end_word"]])


def test_odd_rows_score(spark):
    rows, labels = corpus(200, 6)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learned(docs(spark, rows), told, F.lit(True))
    found = toxicity.scored(widened(docs(spark)), model).collect()
    assert len(found) == len(odd_rows())
    assert all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.scored(docs(spark, []), model).count() == 0


def test_without_labels_every_score_is_zero(spark):
    told = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learned(docs(spark), told, F.lit(True))
    assert {r["score"] for r in toxicity.scored(docs(spark), model).collect()} == {0.0}


def test_sample_is_bounded(spark):
    rows, labels = corpus(400, 7)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    picked = toxicity._labelled(docs(spark, rows), told, F.lit(True), toxicity.Settings(most_labelled=100), "text", "doc_id", "toxic")
    assert 60 < picked.count() < 140
