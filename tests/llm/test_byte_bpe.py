import base64
import hashlib
import struct

import pytest

from plumbline.llm import byte_bpe as B

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "Hello world", "<|endoftext|> x", "a" * 5000, "é" * 3000, "日本語のテキスト🙂 and\n\n  spaces\t\ttabs", "it's we'll I'd", "0123456789 1,234.5", "\x00\x01\x7f", "x y\u00a0z\u2028", "İstanbul ﬁ", "ab" * 40 + " " + "q" * 70]


def test_equals_tiktoken(spark):
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t, 5) for i, t in enumerate(TEXTS)] + [(3, "Hello world", 5), (None, "null id", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    want = []
    for i, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = sorted(map(tuple, B.encode_decode(df, PATH, P.PATTERN, digest=True).collect()), key=str)
    assert got == sorted(want, key=str)
    full = B.encode_decode(df, PATH, P.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (dict((i, t) for i, t, _ in rows)[r.doc_id] or "") for r in full)
    assert B.encode_decode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = B.PerfectHash(keys)
    assert sorted(map(h.slot, keys)) == list(range(5000))
    assert 0 <= h.slot(b"unknown") < 5000
    assert B.PerfectHash([b"one"]).slot(b"one") == 0


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 3)
    c = B.Codec(PATH, P.PATTERN)
    texts = [f"word{i} other{i} " + "z" * 100 for i in range(50)]
    assert [c.decode(x).decode() for x in c.encode(texts)] == texts
    assert len(c.known) <= 3
    c.known.pop(next(iter(c.known)))
    c.encode([f"more{i}" for i in range(50)])  # a table that is nearly full does not overflow
    assert len(c.known) <= 3
