import collections
import math
import random

import numpy as np
import pytest

from plumbline.llm import suffix_lm as L


def corpus(n=700):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 30)):
            w += rng.choice(["The cat sat", "a dog ran", "the bird | x%d |" % rng.randint(0, 300)]).split()
        rows.append((i, " ".join(w)))
    return rows + [(n, None), (n + 1, ""), (5, "the cat"), (None, "the cat sat")]


def tokens_of(text):
    return [x for x in (text or "").lower().split(" ") if x] + [None]


class Plain:
    """The same tree as a dictionary of every string of the training texts."""

    def __init__(self, rows, spread=L.SPREAD):
        self.spread = spread
        self.followers = collections.defaultdict(collections.Counter)
        for i, text in rows:
            if not L.held_out(i):
                t = [None, *tokens_of(text)]
                for k in range(1, len(t)):
                    for length in range(min(k, L.DEPTH) + 1):
                        self.followers[tuple(t[k - length : k])][t[k]] += 1
        self.total, self.words = self.followers[()].total(), len(self.followers[()])
        self.kept = {}

    def retained(self, ctx):
        if ctx not in self.kept:
            f = self.followers.get(ctx, {})
            whole = sum(f.values())
            if whole < L.LEAST:
                self.kept[ctx] = False
            else:
                gain = sum(n * (math.log(n / whole) + float(np.float16(-math.log(self.p(ctx[1:], w))))) for w, n in f.items())
                self.kept[ctx] = whole > self.spread or gain - len(f) / 2 >= L.DIVERGES * whole
        return self.kept[ctx]

    def p(self, ctx, word):
        if not ctx:
            return (self.followers[()][word] + 1) / (self.total + self.words + 1)
        below = self.p(ctx[1:], word)
        if not self.retained(ctx):
            return below
        f = self.followers[ctx]
        return (f[word] + L.SMOOTH * below) / (f.total() + L.SMOOTH)

    def score(self, text):
        t = [None, *tokens_of(text)]
        return sum(math.log10(self.p(tuple(t[max(0, k - L.DEPTH) : k]), t[k])) for k in range(1, len(t)))


@pytest.mark.parametrize("spread, docs", [(1_000_000, 2000), (300, 50)])
def test_scores_equal_brute_force(spark, spread, docs):
    rows = corpus()
    tokens = [tokens_of(t) for _, t in rows]
    train = collections.Counter(x for (i, _), t in zip(rows, tokens) if not L.held_out(i) for x in t)
    total, words = sum(train.values()), len(train)
    plain = Plain(rows, spread)
    want = sorted(((i, L.held_out(i), len(t), sum(train[x] > 0 for x in t), total, round(sum(math.log10((train[x] + 1) / (total + words + 1)) for x in t), 6), round(plain.score(text), 5)) for (i, text), t in zip(rows, tokens)), key=str)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, w int")
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 5)) for r in L.score(df, spread=spread, block_docs=docs).collect()), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], atol=1e-4)
    held = [x for x in got if x[1]]
    assert sum(x[6] for x in held) > 0.5 * sum(x[5] for x in held)
    assert any(plain.kept.values()) and not all(plain.kept.values())
    assert any(kept for ctx, kept in plain.kept.items() if len(ctx) == L.DEPTH)


def test_frequent_contexts_take_the_same_test(spark):
    """Contexts that are dealt by string because they are frequent are retained or not as the divergence test says."""
    rows = corpus()
    plain = Plain(rows, spread=float("inf"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, round(r.score, 5)) for r in L.score(df, block_docs=50, dealt=300).collect()), key=str)
    want = sorted(((i, round(plain.score(text), 5)) for i, text in rows), key=str)
    assert np.allclose([x[1] for x in got], [x[1] for x in want], atol=1e-4) and [x[0] for x in got] == [x[0] for x in want]
    frequent = [plain.retained(ctx) for ctx, f in list(plain.followers.items()) if ctx and f.total() > 300]
    assert any(frequent) and not all(frequent)
    whole = sorted(((r.doc_id, round(r.score, 5)) for r in L.score(df).collect()), key=str)
    assert np.allclose([x[1] for x in got], [x[1] for x in whole], rtol=0, atol=1e-9)


def test_distributions_sum_to_one():
    plain = Plain(corpus())
    every = [*plain.followers[()], "never seen"]
    for before in ((), ("the",), (None, "the"), ("a", "dog", "ran"), ("cat", "sat", "a"), ("no", "such", "word")):
        assert abs(sum(plain.p(before, w) for w in every) - 1) < 1e-9


def test_the_tree_grows_with_the_corpus(spark):
    """A pair of words seen in two texts is learnt however many other texts there are."""
    other = corpus(3000)
    a, b, c = [i for i in range(100) if not L.held_out(i)][:3]
    rows = [(i + 100, t) for i, t in other if i is not None] + [(a, "zebra quagga okapi"), (b, "zebra quagga okapi"), (c, "zebra kiang onager")]
    got = {r.doc_id: r for r in L.score(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 100").collect()}
    assert got[a].score == got[b].score > got[a].base_score + 4
    assert got[a].score > got[c].score


def test_one_word_blocks_and_no_training_texts(spark):
    held = [i for i in range(40) if L.held_out(i)][:3]
    got = L.score(spark.createDataFrame([(i, t) for i, t in zip(held, ["a b", None, "a"])], "doc_id long, text string")).collect()
    assert {(r.n_known, r.train_tokens, r.score) for r in got} == {(0, 0, 0.0)}


def test_empty(spark):
    assert L.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
