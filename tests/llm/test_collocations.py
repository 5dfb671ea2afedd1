import collections
import random
import re
import tracemalloc
import types

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, longest=3, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        hidden = {q[i : i + k] for q, b in good.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= 50 * c[q[i : i + k]]}
        rows = []
        for p, a in good.items():
            if p not in hidden:
                s, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def corpus():
    rng = random.Random(3)
    words = ["New", "york", "city", "é", "a", "b", "of", "the", "ÉA", "x y", " "] + [f"w{i}" for i in range(300)]
    out = [(None, None), ("en", ""), ("en", " \t\n.,"), (None, "new york. " * 12), ("fr", "Ça va? " * 20), ("en", "a a a a a a a a a a a a"), ("en", "q\x00r s\x1ft. " * 11)]
    for _ in range(500):
        text = ""
        for _ in range(rng.randint(1, 60)):
            text += rng.choice(["New York City", "york city", "of the", words[int(len(words) * rng.random() ** 3)], "NEW york"]) + rng.choice([" ", " ", " ", "\t ", ". ", "!", "\n", "\x0b"])
        out.append((rng.choice(["en", "en", "en", "fr", None]), text))
    return out


@pytest.mark.parametrize("mass", [C.MASS, 4000])
@pytest.mark.parametrize("bits", [C.BITS, 12])
def test_equals_brute_force(spark, mass, bits):
    rows = corpus()
    df = spark.createDataFrame([(i, t, lang, 5) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n int")
    assert sorted(tuple(r) for r in C.mine(df, bits=bits, mass=mass).collect()) == brute(rows)


def test_longer_phrases_and_fewer_rows(spark):
    rows = corpus()
    df = spark.createDataFrame([(t, lang) for lang, t in rows], "body string, code string")
    got = C.mine(df, threshold=4, longest=4, top=25, lang_col="code", text_col="body").collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 4, 4, 25)
    assert C.mine(df.limit(0), lang_col="code", text_col="body").count() == 0


def test_every_frequent_key_survives_any_order_of_merging():
    rng = np.random.default_rng(4)
    for _ in range(30):
        keys = (rng.zipf(1.3, 20_000) % 5000).astype(np.uint64)
        rng.shuffle(keys)
        threshold = int(rng.integers(3, 60))
        capacity = len(keys) // threshold + 1
        parts = [list(C.merged(p, np.ones(len(p), np.int64), capacity)) for p in np.array_split(keys, int(rng.integers(2, 40)))]
        while len(parts) > 1:
            i = int(rng.integers(len(parts) - 1))
            a, b = parts.pop(i), parts.pop(i)
            *new, off = C.merged(np.append(a[0], b[0]), np.append(a[1], b[1]), capacity)
            parts.append([*new, off + a[2] + b[2]])
        values, times = np.unique(keys, return_counts=True)
        h, n, off = parts[0]
        assert set(values[times >= threshold].tolist()) <= set(h[n + off >= threshold].tolist()) and len(h) <= capacity


def test_products_beyond_64_bits(spark):
    a = 5_000_000_000
    got = spark.sql(f"SELECT (1000000 * CAST({a} AS DECIMAL(38, 0)) * CAST({a} AS DECIMAL(38, 0))) div (CAST({a + 1} AS DECIMAL(38, 0)) * CAST({a + 7} AS DECIMAL(38, 0))) AS s").first().s
    assert got == 1_000_000 * a * a // ((a + 1) * (a + 7))


def test_words_of_one_text_at_a_time_are_objects():
    """A stretch of many texts holds its words as numbers, and its phrases leave in parts."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(2000)}" for _ in range(500)).encode() for _ in range(800)]
    tracemalloc.start()
    stretch = C.Stretch("en", texts)
    peak = tracemalloc.get_traced_memory()[1]
    assert peak < 30 * len(stretch.ids)  # as objects in a list, words take some 45 bytes each
    all_marked = types.SimpleNamespace(value=b"\xff" * (1 << 13))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array([t.decode() for t in texts])], names=["lang", "text"])
    sent = list(C._second(iter([batch]), all_marked, 16, 3))
    tracemalloc.stop()
    assert max(b.num_rows for b in sent) <= C.ROWS < sum(b.num_rows for b in sent)
    assert sum(sum(b.column("n").to_pylist()) for b in sent) == 800 * (500 + 500 + 499 + 498)
