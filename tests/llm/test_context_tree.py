import collections
import math
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from gitloom.llm import context_tree
from tests.llm.cases import docs, lowered, odd_rows, sentence, widened, words


class Plain:
    """The same tree, node by node."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, collections.Counter(), collections.defaultdict(set)
        for data in texts:
            for context, byte in self.steps(data):
                for d in range(depth + 1):
                    for node, bit in self.bits(byte):
                        self.counts[(context[depth - d :], node, bit)] += 1
                        if d:
                            self.children[(context[depth - d + 1 :], node)].add(context[depth - d :])
        self.mixed = lru_cache(None)(self.mixed)

    def steps(self, data):
        whole = bytes([254]) * self.depth + data + b"\xff"
        return [(whole[i - self.depth : i], whole[i]) for i in range(self.depth, len(whole))]

    @staticmethod
    def bits(byte):
        return [((1 << b) | (byte >> (8 - b)), (byte >> (7 - b)) & 1) for b in range(8)]

    def own(self, context, node):
        a, b = (self.counts[(context, node, x)] for x in (0, 1))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def mixed(self, context, node):
        if len(context) == self.depth:
            return self.own(context, node)
        below = sum(self.mixed(c, node) for c in self.children[(context, node)])
        return math.log(0.5) + np.logaddexp(self.own(context, node), below)

    def score(self, data):
        total = 0.0
        for context, byte in self.steps(data):
            for node, bit in self.bits(byte):
                p = 0.5
                for d in range(self.depth, -1, -1):
                    at = context[self.depth - d :]
                    counts = [self.counts[(at, node, x)] for x in (0, 1)]
                    w = 1.0 if d == self.depth else math.exp(math.log(0.5) + self.own(at, node) - self.mixed(at, node))
                    p = w * (counts[bit] + 0.5) / (sum(counts) + 1) + (1 - w) * p
                total += math.log10(p)
        return total


def compare(spark, rows, model, train):
    held = lambda r: not train(r)
    told = [r for r in rows if not held(r)]
    tree = Plain([lowered(r[1]).encode() for r in told], model.depth)
    counts = collections.Counter(w for r in told for w in (*words(lowered(r[1])), None))
    n, v = sum(counts.values()), len(counts)
    found = context_tree.scored(widened(docs(spark, rows)), F.coalesce(F.col("doc_id"), F.lit(0)) % 5 != 0, model).collect()
    got = sorted((str(r["id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), r["train"], r["score"]) for r in found)
    want = []
    for r in rows:
        own = [*words(lowered(r[1])), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want.append((str(r[0]), len(own), sum(counts[w] > 0 for w in own), n, round(base, 6), not held(r), tree.score(lowered(r[1]).encode())))
    want.sort()
    assert [g[:6] for g in got] == [w[:6] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[6], w[6], rel_tol=1e-5, abs_tol=1e-5)


def test_scores_match_the_tree(spark):
    rows = [(i, sentence(i, 4 + i % 9), "en", "a", 1) for i in range(40)]
    short = [r if r[0] != 7 else (7, "Short one", "en", "c", 9) for r in odd_rows() if r[0] != 9]
    compare(spark, rows + short, context_tree.Model(depth=3, docs_per_block=9), lambda r: (r[0] or 0) % 5 != 0)


def test_two_bytes_of_context(spark):
    rows = [(i, "abracadabra" * (i % 4), "en", "a", 1) for i in range(12)]
    compare(spark, rows, context_tree.Model(depth=2), lambda r: r[0] % 5 != 0)


def test_predictions_of_a_node_add_up_to_one():
    keys = np.array([((c << 8) | x) << 0 for c in (0x616263, 0x616264) for x in range(256)], np.uint64)
    counts = np.random.default_rng(1).integers(0, 9, len(keys))
    predictions, tops = context_tree.subtree(keys, counts, 3)
    total = np.exp(sum(np.log(p) for p in predictions))
    assert np.allclose(total.reshape(2, 256).sum(axis=1), 1.0)


def test_nothing_to_learn_from(spark):
    found = context_tree.scored(docs(spark, [(5, "ab", "en", "a", 1)]), F.lit(False)).collect()
    assert math.isclose(found[0]["score"], 3 * 8 * math.log10(0.5), rel_tol=1e-6)
    assert context_tree.scored(docs(spark, []), F.lit(True)).count() == 0
