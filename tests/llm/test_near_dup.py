import random

import pytest

from plumbline.llm import near_dup as N


def brute(rows):
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    top = lambda x: x if comp[x] == x else top(comp[x])
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                p, q = top(a), top(b)
                comp[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in sets}


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(3, 150))]
        for _ in range(rng.choice([1, 1, 2, 5, 9])):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    chain = [word() for _ in range(60)]
    for k in range(12):  # each near the next, the ends far apart
        rows.append(" ".join(chain[k * 2 :] + [word() for _ in range(2 * k)]))
    rows += [None, "", " \n ", "One two", "one TWO", "É é Ü İ one two", "é é ü i one two", "one two three", rows[0].upper(), rows[0]]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("tight", [False, True])
def test_components_equal_brute_force(spark, monkeypatch, tight):
    if tight:  # every node is large: blocks, branches and the last level's way are taken
        monkeypatch.setattr(N, "BLOCK", 4)
        monkeypatch.setattr(N, "MOST_WORK", 6)
        monkeypatch.setattr(N, "LEVELS", 1)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.classify(df).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(rows).items()}


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in N.classify(df).collect())) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert N.classify(df.limit(0)).count() == 0
