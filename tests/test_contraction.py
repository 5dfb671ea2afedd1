"""Components by chunks of sorted edges against a plain union of sets."""

import random

import pytest

from plumbline.operators import graph


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("shape", ["local", "random", "path", "hub"])
def test_components_of_chunks(spark, monkeypatch, shape):
    monkeypatch.setattr(graph, "CHUNK", 100)
    rng = random.Random(shape)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    edges = {
        "local": [(x := rng.randint(0, 5000), x // 8 * 8 + rng.randint(0, 7)) for _ in range(900)],
        "random": [(rng.randint(0, 900), rng.randint(0, 900)) for _ in range(500)],
        "path": [(k, k + 1) for k in range(400)] + [(5, 5), (990, 990), (991, None)],
        "hub": [(600, k) for k in range(599)] + [(k, 700) for k in range(650, 690)],
    }[shape]
    rng.shuffle(edges)
    for kind, of in (("bigint", lambda x: x), ("string", lambda x: x if x is None else f"k{x}")):
        some = [(of(a), of(b)) for a, b in edges + edges[:5]]
        found = graph.components(spark.createDataFrame(some, f"a {kind}, b {kind}")).collect()
        assert {r.id: r.component for r in found} == plain(some) and len(found) == len({r.id for r in found})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components_that_lie_together_need_no_rounds(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a round of stars")

    monkeypatch.setattr(graph, "_star", never)
    edges = [(10 * k + i, 10 * k + i + 1) for k in range(50) for i in range(5)]
    assert {r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == {10 * k for k in range(50)}
