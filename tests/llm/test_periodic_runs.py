import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import periodic_runs as R
from plumbline.llm import queries


def brute(w):
    """Every maximal stretch by trying all starts and periods."""
    out, n = set(), len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i if j > i else 0
            if length >= max(6, 4 * q):
                stretch = w[i : i + length]
                if not any(all(stretch[k] == stretch[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(w, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def texts():
    rng = random.Random(5)
    out = [None, "", " \n", "a", "x " * 5, "x " * 6, "a b " * 4, "a b " * 3 + "a", "a b c " * 4 + "a b", "a a b " * 9, "a b c d " * 7]
    for _ in range(400):
        size, letters = rng.randint(0, 90), rng.choice(["ab", "abc", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"])
        w = [rng.choice(letters) for _ in range(size)]
        for _ in range(rng.randint(0, 3)):
            p = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
            k = rng.randrange(len(w) + 1)
            w[k:k] = (p * 9)[: rng.randint(2, 9 * len(p))]
        out.append("".join(x + rng.choice(" \n\t") for x in w))
    out.append(" ".join(rng.choice("ab") for _ in range(700)) + " " + "q r s t u v w x y z " * 40)
    return out


def test_runs_equal_brute_force():
    rng = random.Random(6)
    each = [(t or "").split() for t in texts()]
    each += [[rng.choice("ab") for _ in range(rng.randint(0, 30))] for _ in range(2000)]
    flat = [x for w in each for x in w]
    ids = {x: i for i, x in enumerate(dict.fromkeys(flat))}
    n = np.array([len(w) for w in each])
    got = R.find(np.array([ids[x] for x in flat]), np.repeat(np.arange(len(n)), n)).tolist()
    base = np.append(0, np.cumsum(n))
    assert got == [[s + int(base[i]), length, q] for i, w in enumerate(each) for s, length, q in brute(w)]
    assert len(got) > 900


def test_rare_words_split_until_nothing_changes():
    w = np.array([ord(c) for c in "abababab" + "z" + "abcabcabcabc" + "y" + "dddd"])
    at, segment = R._survivors(w, np.zeros(len(w), np.int64))
    assert "".join(chr(x) for x in w[at]) == "abababab" + "abcabcabcabc" and len(set(segment)) == 2


@pytest.mark.parametrize("rows", [0, 1])
def test_query_digest(spark, tmp_path, rows):
    table = list(enumerate(texts()))[: None if rows else 0] + [(None, "a b " * 9), (7, "b b b b b b b"), (7, "b b b b b b b")] * rows
    spark.createDataFrame([(i, t, 1) for i, t in table], "doc_id long, text string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).drop("n_words").collect()), key=repr)
    want = []
    for i, t in table:
        w = planted(re.findall(r"[^\x20\x09-\x0D]+", t or ""), i)
        runs = brute(w)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        top = min(((-length, s, q) for s, length, q in runs), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(runs), *((top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4), sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert got == sorted(want, key=repr)


def test_one_long_text(spark):
    rng = random.Random(8)
    noise = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(n))
    text = noise(100_000) + " start " + "one two three four five " * 20_000 + "stop " + noise(100_000)
    r = R.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.expr("filter(runs, r -> r.length > 1000)").alias("r"), "n_words").first()
    assert [tuple(x) for x in r.r] == [(100_001, 100_000, 5)] and r.n_words == 300_002
