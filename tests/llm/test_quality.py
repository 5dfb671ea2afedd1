import collections
import random
import re

import pytest

from plumbline.llm import quality as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    longest, covered = 0, set()
    for a in range(len(w)):
        best = 0
        for b in range(len(w)):
            k = 0
            while a != b and max(a, b) + k < len(w) and w[a + k] == w[b + k]:
                k += 1
            best = max(best, k)
        if best >= Q.LEAST:
            longest = max(longest, best)
        if best >= Q.LONG:
            covered.update(range(a, a + best))
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(rep), "n_covered": len(covered), "longest_repeat": longest,
    }


def corpus():
    rng = random.Random(7)
    out = [None, "", "  \n ", "one", "a b c d e a b c d e", "x " * 60, "# $ % \u00a0 é\u2028x", "line one here\nline one here\n\nline one here \n" * 3]
    for _ in range(120):
        words = [rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(0, 3)):
            a, n = rng.randrange(len(words)), rng.randint(4, 30)
            words += words[a : a + n]
        out.append("".join(x + rng.choice([" ", " ", "\n", "\t"]) for x in words))
    return out


def test_measures_equal_brute_force():
    texts = corpus()
    m = Q.measures(texts)
    for i, t in enumerate(texts):
        assert {k: int(v[i]) for k, v in m.items()} == brute(t), t


@pytest.mark.parametrize("n", [0, 1])
def test_judge(spark, n):
    texts = corpus()[: None if n else 0]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, "a b", 3)] * n, "doc_id long, text string, n_words int")
    got = Q.judge(df).collect()
    assert len(got) == len(texts) + n
    for r in got:
        if r.doc_id is not None:
            b = brute(texts[r.doc_id])
            assert r.base_failed == (b["n_words"] < 10 or 100 * b["n_repeat_words"] > 20 * b["n_words"]) and not (r.base_failed and r.kept)
    assert Q.passed(df).count() == sum(r.kept for r in got) and Q.passed(df).columns == df.columns
