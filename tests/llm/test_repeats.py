import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gitloom.llm import packed, repeats, shared_sets
from tests.llm.cases import docs, odd_rows, sentence, widened

LENGTH = 50


def plain(rows):
    """(id, body) -> removed flags, by comparing all strings."""
    body = lambda r: (r[1] or "").encode()
    rank = lambda r: (1 << 70) if r[0] is None else r[0]
    low = {}
    for r in rows:
        data = body(r)
        for p in range(len(data) - LENGTH + 1):
            s = data[p : p + LENGTH]
            low[s] = min(low.get(s, 1 << 71), rank(r))
    found = {}
    for r in rows:
        data, flags = body(r), bytearray(len(body(r)))
        for p in range(len(data) - LENGTH + 1):
            if low[data[p : p + LENGTH]] < rank(r):
                flags[p : p + LENGTH] = b"\x01" * LENGTH
        found[(r[0], data)] = flags
    return found


def compare(spark, rows, rule=repeats.Rule()):
    want = plain(rows)
    found = repeats.without_repeats(widened(docs(spark, rows)), rule).collect()
    assert len(found) == len(rows)
    for r in found:
        data = (r["_row"]["text"] or "").encode()
        flags = want[(r["_row"]["doc_id"], data)]
        got = bytearray(len(data))
        for s in r["spans"]:
            got[s["start"] : s["start"] + s["length"]] = b"\x01" * s["length"]
        assert got == flags
        assert bytes(r["kept"]) == bytes(b for b, gone in zip(data, flags) if not gone)
        assert r["n_bytes"] == len(data)
        assert len(r["spans"]) == sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))


def test_odd_rows(spark):
    compare(spark, odd_rows())


def test_shared_passages_with_any_surroundings(spark):
    rng = random.Random(2)
    passages = [sentence(s, 12)[: rng.randrange(45, 120)] for s in range(6)]
    rows = []
    for i in range(120):
        text = "".join(rng.choice("abcdefgh éß\x00") for _ in range(rng.randrange(0, 90)))
        for _ in range(rng.randrange(4)):
            cut = rng.choice(passages)
            cut = cut[rng.randrange(20) :]
            text += cut + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30)))
        rows.append((rng.randrange(60), text, "en", "a", 1))
    compare(spark, rows)


def test_periodic_text(spark):
    rows = [(i, "ab" * (30 + i) + "xyz" * (i % 3), "", "", 0) for i in range(20)] + [(99, "In. " * 80, "", "", 0), (98, "In. " * 30, "", "", 0)]
    compare(spark, rows)


def test_pieces_of_a_long_text(spark, monkeypatch):
    text = " ".join(sentence(s, 50) for s in range(30))
    rows = [(1, text, "", "", 0), (2, "x" + text[500:9000] + "y" + text[100:300], "", "", 0)]
    monkeypatch.setattr(repeats, "PIECE", 700)
    stream = repeats.Stream([text.encode()], repeats.Rule())
    whole = set(stream.anchors(repeats.Rule())[0].tolist())
    parts = next(iter([list(repeats._pieces([(1, 1, text.encode())], repeats.Rule()))]))
    pieces = set()
    for part in parts:
        got = repeats.Stream([p[3] for p in part], repeats.Rule())
        at, _ = got.anchors(repeats.Rule())
        owner = got.owner(at)
        pieces |= set((at - got.begins[owner] + np.array([p[2] for p in part])[owner] + LENGTH).tolist())
    assert pieces == whole
    compare(spark, rows)


def test_empty_table(spark):
    assert repeats.without_repeats(docs(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=0, max_size=9), st.text("ab", min_size=0, max_size=9), st.integers(0, 4)), min_size=1, max_size=12))
def test_interval_tree_finds_every_string(made):
    """Surroundings of one anchor: bit s is set where another's same string has a smaller rank."""
    rule = repeats.Rule(length=8, gram=3)
    rows, ranks = [], []
    for left, right, rank in made:
        wide = np.zeros(rule.left + rule.length, np.uint8)
        l, r = left[-rule.left :], ("aba" + right)[: rule.length]
        wide[rule.left - len(l) : rule.left] = np.frombuffer(l.encode(), np.uint8) + 1
        wide[rule.left : rule.left + len(r)] = np.frombuffer(r.encode(), np.uint8) + 1
        rows.append(wide)
        ranks.append(rank)
    contexts, ranks = np.array(rows), np.array(ranks)
    got = repeats.repeated(contexts, ranks, rule)
    for i in range(len(rows)):
        for s in range(rule.left + 1):
            window = contexts[:, rule.left - s : rule.left - s + rule.length]
            whole = (window[i] > 0).all()
            low = min(r for w, r in zip(window, ranks) if (w == window[i]).all())
            assert bool(int(got[i]) >> s & 1) == bool(whole and low < ranks[i])


def test_groups_are_judged_apart():
    rng = np.random.default_rng(4)
    rule = repeats.Rule()
    grams = rng.integers(1, 4, size=(12, rule.gram))
    contexts = rng.integers(1, 3, size=(3000, rule.left + rule.length)).astype(np.uint8)
    contexts[:, rule.left : rule.left + rule.gram] = grams[rng.integers(0, 12, 3000)]
    contexts[1500:] = contexts[rng.integers(0, 1500, 1500)]
    contexts[2000:, :20] = 5
    ranks = rng.integers(0, 400, 3000)
    parts = list(repeats.by_gram(contexts, rule, 300))
    assert len(parts) > 3 and sorted(np.concatenate(parts).tolist()) == list(range(3000))
    got = np.zeros(3000, np.uint64)
    for part in parts:
        got[part] = repeats.repeated(contexts[part], ranks[part], rule)
    want = repeats.repeated(contexts, ranks, rule)
    assert (got == want).all() and want.any()


def test_pieces_and_places_give_their_memory_back(monkeypatch):
    """A worker keeps nothing of one piece of text, or of one place, when it takes up the next."""
    given = []
    for module in (repeats, shared_sets):
        monkeypatch.setattr(module, "give_back", lambda: given.append(1))
    monkeypatch.setattr(repeats, "PIECE", 300)
    rule, n = repeats.Rule(), 6
    bodies = [sentence(1, 40).encode()] * n
    read = pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array(bodies, pa.binary())], ["class", "rank", "body"]
    )
    sets = next(repeats._anchor_sets(rule)(iter([read])))
    sent = list(shared_sets._spread(iter([sets]), 4))
    assert len(given) == 1
    met = sorted((row for b in sent for row in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
    list(shared_sets._meet(iter([shared_sets._packed(met)]), 4))
    list(shared_sets._gather(iter([shared_sets._packed(met)]), 0))
    asked = read.append_column("hashes", sets.column(2))
    given.clear()
    told = list(repeats._contexts(rule, 4)(iter([asked])))
    assert len(given) == len(told) > n
    rows = sorted((row for b in told for row in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
    given.clear()
    list(repeats._judged(rule, 4)(iter([repeats._sent(rows)])))
    assert len(given) == len({r[0] for r in rows if r[1] == repeats.CONTEXTS})


def anchors_of(texts):
    return repeats.Stream([t.encode() for t in texts], repeats.Rule()).anchors(repeats.Rule())


def test_anchors_fill_all_places_alike():
    """The smallest hashes of their strings must not meet in the first places."""
    rng = random.Random(5)
    _, hashes = anchors_of(["".join(rng.choices("abcdefgh ", k=300_000))])
    rows = np.bincount(shared_sets.place_of(hashes, 60), minlength=60)
    assert len(np.unique(hashes)) > 10_000 and rows.max() < 2 * rows.mean() and rows.min() > rows.mean() / 2


def test_anchors_are_the_same_in_blocks(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab c", k=n)) for n in (0, 49, 50, 51, 700, 3, 1500, 64)]
    whole = anchors_of(texts)
    for block in (1, 7, 64, 333):
        monkeypatch.setattr(repeats, "BLOCK", block)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, anchors_of(texts)))
    assert len(anchors_of([])[0]) == 0 and len(anchors_of(["x" * 49])[0]) == 0


class Counted(np.ndarray):
    """Surroundings that note how many of them are taken at a time."""

    taken: list[int] = []

    def __getitem__(self, at):
        got = super().__getitem__(at)
        if isinstance(at, np.ndarray):
            Counted.taken.append(len(got))
        return got


def test_surroundings_are_taken_once_for_any_number_of_places(monkeypatch):
    """What a piece of text costs must not grow with the places, whose number grows with the table."""
    view = np.lib.stride_tricks.sliding_window_view
    monkeypatch.setattr(np.lib.stride_tricks, "sliding_window_view", lambda *a: view(*a).view(Counted))
    rule, n = repeats.Rule(), 8
    bodies = [(sentence(i, 60) + sentence(99, 10)).encode() for i in range(n)]
    read = pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array([0, 0, *range(2, n)], pa.int64()), pa.array(bodies, pa.binary())], ["class", "rank", "body"]
    )
    asked = read.append_column("hashes", next(repeats._anchor_sets(rule)(iter([read]))).column(2))
    copied, sent = {}, {}
    for count in (1, 16, 1000):
        Counted.taken = []
        rows = [row for b in repeats._contexts(rule, count)(iter([asked])) for row in zip(*(c.to_pylist() for c in b.columns))]
        copied[count] = sum(Counted.taken)
        sent[count] = sorted(
            (*row, wide.tobytes())
            for r in rows
            if r[1] == repeats.CONTEXTS
            for *row, wide in zip(
                packed.untagged(r[2]).tolist(),
                packed.untagged(r[4]).tolist(),
                packed.unplain(r[5], np.int64).tolist(),
                packed.unplain(r[3], np.uint8).reshape(-1, rule.left + rule.length),
            )
        )
    assert sent[1] == sent[16] == sent[1000] and len(sent[1]) > 200
    assert copied[1] == copied[16] == copied[1000]


def test_packed_rows_share_a_compressor_and_read_back(monkeypatch):
    packed.plain(np.arange(3))
    made, build = [], packed.zstandard.ZstdCompressor
    monkeypatch.setattr(packed.zstandard, "ZstdCompressor", lambda **k: made.append(k) or build(**k))
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, packed.FEW, packed.FEW + 1, 500):
        names = rng.integers(-(1 << 63), 1 << 63, 20)[rng.integers(0, 20, n)]
        assert (packed.untagged(packed.tagged(names)) == names).all() and len(packed.untagged(packed.tagged(names))) == n
        hashes = np.sort(names.view(np.uint64))
        assert (packed.expanded(packed.squeezed(hashes)) == hashes).all()
    assert not made
