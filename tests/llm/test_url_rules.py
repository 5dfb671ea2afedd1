import random

import pytest

from plumbline.llm import url_rules as U
from plumbline.llm.queries import URL_RULES


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


URLS = [
    None, "", "no scheme", "http://example.com", "http://EXAMPLE.com/en/x?q#f", "https://www.example.com/en/", "https://a.www.example.com/en/1", "http://b.example.com/en", "http://x.net/es/1", "http://net/fr/", "http://net.com/fr/",
    "http://notexample.com/en/", "http://x.net/fr?a=/es/", "://a.com/b", "http://a.com?x=/en/", "http://é.example.com/en/ü", "http://.com/", "http://com./en/", "http://a..com/", "a://b://c.com/d",
]


@pytest.mark.parametrize("sweep", [200_000, 50])
def test_equals_brute_force(spark, monkeypatch, sweep):
    monkeypatch.setattr(U, "ROWS_A_SWEEP", sweep)
    rng = random.Random(4)
    part = lambda: rng.choice(["a", "b", "www", "example", "net", "com", "org"])
    urls = URLS + [f"http://{'.'.join(part() for _ in range(rng.randint(1, 4)))}/{rng.choice(['', 'en/', 'es/', 'fr/x'])}" for _ in range(400)] + ["http://hot.example.com/en/"] * 300
    rows = [(i % 700, u, "clash") for i, u in enumerate(urls)]
    rules = URL_RULES + [("b.example.com", "/", "allow"), ("a.com", "/en/", "block"), ("example.com", "/", "block"), ("", "/", "block")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted(map(tuple, U.judge(df, r).collect()), key=str)
    assert got == sorted([(i, *brute(u, rules[:-1])) for i, u, _ in rows], key=str)


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert U.judge(none, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert U.judge(one, rules.limit(0)).first().verdict == "allow"
