import collections
import time
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gitloom.llm import packing
from tests.llm.cases import docs, odd_rows, sentence, widened

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_ids_are_the_tokenizers(text):
    assert packing.tokens(None, None).ids(text).tolist() == ids(text)


def test_special_strings_are_special_tokens():
    text = "before <|endoftext|> after<|endoftext|>"
    assert packing.tokens(None, None).ids(text).tolist() == ids(text) and 50256 in ids(text)


def check(rows, found, window=2048):
    """Round trip: every id lies in one piece, sequences have no gap and little padding."""
    by_doc, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by_doc[(r["doc_id"], r["doc_tokens"])].append((r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        want[(doc_id, len(ids(text)))].append(ids(text))
    assert set(by_doc) == set(want)
    for key, texts in want.items():
        got = sorted(by_doc[key])
        assert sum(n for _, n, _ in got) == sum(map(len, texts))
        for start, n, crc in got:
            assert crc in {zlib.crc32(np.array(t[start : start + n], "<u4").tobytes()) for t in texts}
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


def test_pieces_hold_every_token_once(spark):
    rows = odd_rows() + [(100 + i, sentence(i % 17, 5 + i % 300), "en", "a", 1) for i in range(150)]
    check(rows, packing.packed(widened(docs(spark, rows))).collect())


def test_small_shards(spark):
    rows = [(i, sentence(i % 5, 40), "en", "a", 1) for i in range(60)]
    check(rows, packing.packed(docs(spark, rows).coalesce(2), packing.Packer(shard_tokens=3000)).collect())


def test_neighbours_share_windows():
    """Documents of one subject follow each other, whatever the order they come in."""
    rng = np.random.default_rng(3)
    subjects = [np.arange(100 * s, 100 * s + 60) for s in range(4)]
    made = [np.append(rng.choice(subjects[i % 4], 50), 1).astype("<u4") for i in range(80)]
    placed = packing.order(made, packing.Packer(window=256))
    assert sorted(placed) == list(range(80))
    same = np.mean([a % 4 == b % 4 for a, b in zip(placed, placed[1:])])
    assert same > 0.85


def test_scores_are_bm25():
    rng = np.random.default_rng(5)
    made = [rng.integers(2, 60, n).astype("<u4") for n in (5, 30, 80, 200, 7)]
    packer = packing.Packer(query_tokens=1000)
    got = packing.Index(made, packer).scores(made[1])
    mean = np.mean([len(d) for d in made])
    for d, doc in enumerate(made):
        want = 0.0
        for t in set(made[1].tolist()):
            df = sum(t in x for x in made)
            if df > 1:
                tf = int((doc == t).sum())
                idf = np.log(1 + (5 - df + 0.5) / (df + 0.5))
                want += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean))
        assert abs(got[d] - want) < 1e-9


def test_default_scores_ask_every_token():
    rng = np.random.default_rng(6)
    made = [rng.integers(2, 90, 120).astype("<u4") for _ in range(12)]
    got = packing.Index(made, packing.Packer()).scores(made[0])
    every = packing.Index(made, packing.Packer(query_tokens=1000)).scores(made[0])
    few = packing.Index(made, packing.Packer(query_tokens=16)).scores(made[0])
    assert np.allclose(got, every) and not np.allclose(got, few)


def test_an_unused_sharer_goes_before_the_next_in_order():
    """The seed's rarest tokens stand in one used document; of its common ones the last document has most."""
    rare, common = np.arange(100, 120), np.arange(10, 30)
    made = [np.append(rare, common), rare, *[np.arange(200, 220)] * 6, common]
    placed = packing.order([d.astype("<u4") for d in made], packing.Packer(window=200))
    assert placed[:3] == [0, 1, 8]


def test_very_many_short_texts_pack_in_seconds():
    """Empty ones follow the others; of short ones a window asks the index a few times, not once for each eight."""
    rng = np.random.default_rng(7)
    empty, short = [np.array([1], "<u4")] * 64_000, [np.array([int(t), 1], "<u4") for t in rng.integers(2, 40, 30_000)]
    begin = time.monotonic()
    placed = packing.order([*empty, *short], packing.Packer())
    assert sorted(placed) == list(range(94_000)) and placed[30_000:] == list(range(64_000))
    assert time.monotonic() - begin < 20


def test_empty_table(spark):
    assert packing.packed(docs(spark, [])).count() == 0
