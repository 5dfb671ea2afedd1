import random
import zlib

import numpy as np
import pytest

from plumbline.llm import quality_cnn as Q
from plumbline.llm import queries

DIR = "/root/testdata/sf0.01"


def corpus(n=160, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = i % 2
        w = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7))) + ("$$" if bad else "") for _ in range(rng.randint(20, 120))]
        out.append((i, " ".join(w), 1 - bad))
    return out


def test_gradients_equal_differences():
    net = Q.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["filter_bias"] += np.random.default_rng(1).normal(0, 0.1, Q.FILTERS)  # away from the kink at which an empty text stands
    texts = [t.encode() for _, t, _ in corpus(8)] + [b"", b"short"]
    y, w = np.array([1, 0] * 5), np.linspace(0.5, 1.5, 10)
    laid = Q._laid_out(texts)

    def loss():
        z = net.logits(*laid)
        return float(np.sum(w * (np.logaddexp(0, z) - y * z)) / len(y))

    g, rng = net.gradients(*laid, y, w), np.random.default_rng(0)
    for name, x in net.p.items():
        for _ in range(12):
            at = tuple(int(rng.integers(k)) for k in x.shape) if name != "bytes" else (int(rng.choice(list(b"aeiou$ "))), int(rng.integers(Q.VECTOR)))
            was, step = x[at], 1e-5
            x[at] = was + step
            up = loss()
            x[at] = was - step
            down = loss()
            x[at] = was
            assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=0.01, abs=1e-4), (name, at)


def test_every_byte_is_covered_and_texts_do_not_touch():
    net = Q.Network(4)
    a, b = b"x" * 5000, b"y" * 333
    alone = [net.logits(*Q._laid_out([t]))[0] for t in (a, b, b"")]
    assert np.allclose(net.logits(*Q._laid_out([a, b, b""])), alone, atol=1e-5)
    was = net._halves(*Q._laid_out([a])[:2])[0]
    for place in (0, 95, 96, 191, 192, 2500, 4999):
        other = a[:place] + b"\xf0" + a[place + 1 :]
        assert np.abs(net._halves(*Q._laid_out([other])[:2])[0] - was).max() > 0, place


def test_learns_and_scores(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "z", 9.0) for i, t, _ in rows] + [(None, None, "z", 0.0), (7, None, "z", 0.0), (900, "", "z", 0.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0), (5000, 0, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels)
    again = Q.fit(docs.repartition(3), labels.repartition(2))
    assert all(np.array_equal(model[k], again[k]) for k in model)
    test = corpus(80, 2) + [(500, " ".join(t for _, t, q in corpus(30, 3) if q) * 40, 1), (500, " ".join(t for _, t, q in corpus(30, 3) if not q) * 40, 0)]
    got = Q.score(spark.createDataFrame([(i, t, 3) for i, t, _ in test] + [(None, None, 3)], "doc_id long, text string, score int"), model).collect()
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 83
    assert np.mean([(r.score >= 0.5) == q for r, (_, _, q) in zip(sorted(got[:80], key=lambda r: r.doc_id), test)]) > 0.95
    assert sorted(r.score for r in got if r.doc_id == 500)[0] < 0.5 < sorted(r.score for r in got if r.doc_id == 500)[1]
    assert Q.score(docs.limit(0), model).count() == 0


def test_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.fit(docs, none) == 0.5 and Q.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")) == 1.0
    assert [r.score for r in Q.score(docs, 0.5).collect()] == [0.5, 0.5]


def test_held_out_accuracy(spark):
    got = queries.op13_quality_cnn(spark, DIR)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id", "left").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows) and len(rows) == 1000
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
    assert np.mean([r.predicted == 0 for r in held if r.quality == 0]) > 0.7
