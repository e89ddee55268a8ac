import random

import numpy as np
import pyarrow as pa

from gitloom.llm import prefix_blocks, shingle_join
from gitloom.llm.components import components
from tests.llm.cases import docs, lowered, odd_rows, sentence, widened, words


def plain_set(text):
    got = words(lowered(text))
    if len(got) < 5:
        return frozenset([tuple(got)]) if got else frozenset()
    return frozenset(zip(got, got[1:], got[2:], got[3:], got[4:]))


def plain(rows):
    """Per row (size, component, links), by comparing all pairs."""
    sets = [plain_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    lows = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            lows[root(i)] = min(lows.get(root(i), r[0]), r[0])
    return [(len(sets[i]), r[0] if not sets[i] else lows.get(root(i)), links[i]) for i, r in enumerate(rows)]


def compare(spark, rows, join=shingle_join.Join()):
    found = shingle_join.grouped(widened(docs(spark, rows)), join).collect()
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    got = sorted(((r["id"], r["n"], r["component"], r["links"]) for r in found), key=key)
    assert got == sorted(((r[0], *p) for r, p in zip(rows, plain(rows))), key=key)


def near_copies(n, seed):
    rng = random.Random(seed)
    base = [sentence(s, 80).split() for s in range(4)]
    rows = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 3, 5))):
            text[rng.randrange(len(text))] = f"new{rng.randrange(1000)}"
        rows.append((i, " ".join(text[rng.randrange(8) :]), "en", "a", 1))
    return rows


def test_near_copies(spark):
    compare(spark, near_copies(150, 1))


def test_a_block_in_parts(spark):
    """Parts of a block meet pair by pair; links across and within count once."""
    compare(spark, near_copies(120, 2), shingle_join.Join(part_sets=10))


def test_odd_rows(spark):
    compare(spark, odd_rows())


def test_one_of_each_group_stays(spark):
    rows = near_copies(60, 3) + odd_rows()
    want = plain(rows)
    frame = widened(docs(spark, rows))
    stay = shingle_join.kept(frame)
    assert stay.columns == frame.columns
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in stay.collect())
    ids = {(r[0], r[1]) for r, (n, c, _) in zip(rows, want) if r[0] == c and (n == 0 or r[0] is not None)}
    alone = {(r[0], r[1]) for r, (n, c, _) in zip(rows, want) if r[0] is None and c is None}
    texts = {}
    for i, t in ids | alone:
        texts.setdefault(i, set()).add(t)
    assert {(g[1] if g[0] else None) for g in got} == set(texts)
    assert all((g[2] or None) in texts[g[1] if g[0] else None] or g[2] in texts[g[1] if g[0] else None] for g in got)


def test_answers_of_like_sets_are_derived_right():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 40, 120).astype(np.uint64))
    sets = []
    for _ in range(90):
        drop = rng.random(len(base)) > rng.choice([0.02, 0.1, 0.3])
        sets.append(np.unique(np.append(base[drop], rng.integers(0, 1 << 40, 5).astype(np.uint64))))
    sets.sort(key=len)
    sizes = np.array([len(s) for s in sets])
    index = shingle_join.SetIndex(sets, sizes, shingle_join.Join())
    for x, found in index.answers():
        want = [
            y
            for y in range(len(sets))
            if y != x
            and 100 * len(np.intersect1d(sets[x], sets[y])) >= 75 * len(np.union1d(sets[x], sets[y]))
        ]
        assert found.tolist() == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (200, 200), (7, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_empty_table(spark):
    assert shingle_join.grouped(docs(spark, [])).count() == 0
    assert shingle_join.kept(docs(spark, [])).count() == 0


def test_a_block_with_empty_parts(spark):
    """As many parts as sets: a task of two parts of which one is empty counts nothing again."""
    compare(spark, near_copies(40, 5), shingle_join.Join(part_shingles=75))


def test_rows_of_one_id_or_none_stay_if_nothing_links_them(spark):
    rows = [(None, sentence(s, 60), "en", "a", 1) for s in (1, 4, 6, 9)]
    rows += [(5, sentence(s, 60), "en", "a", 1) for s in (2, 7, 8)]
    rows += [(None, None, "en", "a", 1), (None, "", "en", "a", 1), (5, "", "en", "a", 1)]
    again = [rows[0], rows[4], rows[7], (6, rows[4][1] + " more", "en", "a", 1)]
    stay = shingle_join.kept(docs(spark, rows + again)).collect()
    assert sorted(map(repr, map(tuple, stay))) == sorted(map(repr, rows))


def test_each_text_is_read_once(spark, monkeypatch):
    read, make = spark.sparkContext.accumulator(0), shingle_join._sets

    def counted(join):
        run = make(join)

        def watched(batches):
            def passing():
                for batch in batches:
                    read.add(batch.num_rows)
                    yield batch

            return run(passing())

        return watched

    monkeypatch.setattr(shingle_join, "_sets", counted)
    rows = near_copies(50, 6)
    assert shingle_join.grouped(docs(spark, rows)).count() == len(rows) == read.value


def test_sets_of_many_texts_at_a_time(monkeypatch):
    bodies = [(r[1] or "").encode() for r in odd_rows()] + [b"a b c d", b"a b c d e", b"a b c d e", b"", b"A " * 90]
    alone = [shingle_join.Shingler(5).of([b])[0].tolist() for b in bodies]
    assert [len(s) for s in alone] == [len(plain_set(b.decode())) for b in bodies]
    assert all(s == sorted(set(s)) for s in alone)
    for chunk in (0, 7, 1000, 1 << 16):
        monkeypatch.setattr(shingle_join, "CHUNK", chunk)
        assert [s.tolist() for s in shingle_join.Shingler(5).of(bodies)] == alone
    assert shingle_join.Shingler(5).of([]) == []


def by_row(batches):
    return [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]


def exchanged(batches, step):
    """What *step* makes of packed rows that came to their places."""
    rows = sorted(by_row(batches), key=lambda r: r[0])
    return list(step(iter([prefix_blocks._sent(rows)] if rows else [])))


def test_sets_that_may_link_are_connected():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 63, 3).astype(np.uint64)  # every set has these
    sets = []
    for _ in range(25):
        base = rng.integers(0, 1 << 63, int(rng.integers(30, 60))).astype(np.uint64)
        for _ in range(4):
            own = rng.integers(0, 1 << 63, int(rng.integers(0, 9))).astype(np.uint64)
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > 0.05], own, common])))
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(range(-50, 50), pa.int64()),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([s.tobytes() for s in sets], pa.binary()),
        ],
        ["class", "n", "hashes"],
    )
    count = 5
    asked = [b for a in range(0, 100, 25) for b in prefix_blocks._asked(count)(iter([batch.slice(a, 25)]))]
    for r in by_row(asked):
        if r[1] == prefix_blocks.ASKED:  # a common hash goes out once for all sets of a batch and home
            hashes = prefix_blocks.expanded(r[3])
            assert len(np.unique(hashes)) == len(hashes)
    told = exchanged(asked, prefix_blocks._told)
    edges = by_row(exchanged(exchanged(told, prefix_blocks._prefixes(count, 75)), prefix_blocks._edges))
    parent = {i: i for i in range(-50, 50)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in edges:
        parent[root(u)] = root(v)
    linked = 0
    for i in range(100):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                linked += 1
                assert root(i - 50) == root(j - 50)
    # What all sets have is last in every set and brings no strangers together.
    assert linked > 30 and len({root(i) for i in parent}) >= 25
