import hashlib
import random

import pytest

from plumbline.llm import substring_dedup as S


def brute(rows):
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and least[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(3))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 70, 120, 300)] + [text(3) * 30, text(1) * 90]
    rows = [None, "", "one two", " ".join(text(60))]
    for _ in range(60):
        w = []
        for _ in range(rng.randint(1, 4)):
            w += text(rng.randint(0, 80))
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            w += p[a:] if rng.random() < 0.5 else p
        rows.append(rng.choice([" ", "\n", "\t "]).join(w))
    rows += [rows[5], rows[7], rows[9] + " more", "x " + rows[11]]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    return rows + [rows[3], (None, rows[4][1]), (5, rows[8][1])]


@pytest.mark.parametrize("group", [20_000, 1])
def test_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)  # 1: every shared prefix is extended to the whole window
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, least int")
    got = sorted(map(tuple, S.dedup(df, with_text=True).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
