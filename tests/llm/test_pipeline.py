"""The stages one after another on the smallest documents, each against plain Python on its own input."""

import collections

import pytest
import zstandard

import corpus_pipeline
from gitloom.llm.quality_bands import Bands
from tests.llm import test_line_dedup, test_packing, test_quality_bands, test_shingle_join
from tests.llm.cases import docs, odd_rows, words
from tests.llm.test_curriculum import plain_targets

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


def order(rows):
    return sorted(rows, key=repr)


def passes(text):
    n, _, _, _, repeated = test_quality_bands.plain(text)
    if n < 50 or 100 * repeated > 50 * n:
        return False
    bands = Bands()
    packer = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
    data = text.encode()
    fine = lambda d: bands.inside(len(d), len(packer.compress(d)) / len(d))
    chunks = [data[i : i + bands.chunk] for i in range(0, len(data), bands.chunk)]
    if len(chunks) > 1 and len(chunks[-1]) < 256:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    bad = sum(len(c) for c in chunks if not fine(c))
    return fine(data) and bad <= bands.bad_share * sum(map(len, chunks))


@pytest.mark.parametrize("source", ["given", "odd"])
def test_every_stage(spark, source, tmp_path):
    frame = spark.read.parquet(f"{SF}/documents.parquet") if source == "given" else docs(spark)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near duplicates", "source mix", "packing"]

    def step(name):
        nonlocal frame
        before = rows_of(frame)
        stages[name](spark, frame, SF).write.parquet(str(tmp_path / name))
        columns = frame.columns
        frame = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or frame.columns == columns
        return before, rows_of(frame)

    before, after = step("quality rules")
    assert order(after) == order(r for r in before if passes(r[1]))

    before, after = step("line dedup")
    left = test_line_dedup.plain(before)
    want = []
    for r in before:
        text = left[(r[0], r[1])]
        if text == r[1]:
            want.append(r)
        elif words(text):
            want.append((r[0], text, *r[2:4], len(text)))
    assert order(after) == order(want)

    before, after = step("near duplicates")
    found = test_shingle_join.plain(before)
    stay = {r for r, (n, c, _) in zip(before, found) if r[0] == c}
    assert order(after) == order(stay)

    before, after = step("source mix")
    sizes = collections.Counter()
    for r in before:
        sizes[r[3]] += len(words(r[1]))
    copies = collections.Counter(after)
    assert set(copies) <= set(before) and max(copies.values(), default=0) <= 2
    taken = collections.Counter()
    for r, n in copies.items():
        taken[r[3]] += n * len(words(r[1]))
    for s, target in plain_targets(sizes).items():
        assert abs(taken[s] - target) <= max(len(words(r[1])) for r in before if r[3] == s) / 2 + 1e-6

    before, _ = step("packing")
    test_packing.check(before, frame.collect())


def test_run_is_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns[0] == "doc_id"


def test_odd_rows_are_odd():
    assert any(r[1] is None for r in odd_rows()) and any(r[0] is None for r in odd_rows())
