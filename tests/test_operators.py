import pytest
from pyspark.sql import functions as F

from plumbline.functions import formula
from plumbline.functions import geometry as G
from plumbline.functions import text as T
from plumbline.operators import choose, edits, graph, interval, spatial
from plumbline.operators.tools import TOOLS

DIR = "/root/testdata/sf0.001"


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_geometry(spark):
    pt = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = lambda *p: F.array(*[pt(x, y) for x, y in p])
    square, hole, outside = ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((1, 1), (3, 1), (3, 3), (1, 3)), ring((20, 20), (22, 20), (22, 22), (20, 22))
    assert one(spark, G.area_with_holes(square, F.array(hole, outside))) == 96
    assert one(spark, G.polyline_length(square)) == 30 and one(spark, G.polyline_length(square, True)) == 40
    assert one(spark, G.point_in_ring(F.lit(10.0), F.lit(5.0), square)) and not one(spark, G.point_in_ring(F.lit(10.1), F.lit(5.0), square))
    assert tuple(one(spark, G.centroid(ring((0, 0), (4, 0), (4, 2), (0, 2))))) == (2, 1)
    assert one(spark, G.convert(F.lit(1.0), F.lit("m"), F.lit("cm"), 2)) == 10_000 and one(spark, G.convert(F.lit(1.0), F.lit("m"), F.lit("?"))) is None
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert one(spark, G.collinear(lit(0, 0, 10, 0), lit(11, 0.1, 20, 0.1), 1.5, 0.3)) and not one(spark, G.collinear(lit(0, 0, 10, 0), lit(11, 1, 20, 1), 1.5, 0.3))
    assert tuple(one(spark, G.clip(*lit(0, 5, 10, 5), lit(2, 0, 6, 10)))) == (0.2, 0.6) and one(spark, G.clip(*lit(0, 50, 10, 50), lit(2, 0, 6, 10))) is None
    curve = one(spark, G.flatten_bezier([lit(0, 0), lit(0, 4), lit(8, 4), lit(8, 0)]))
    assert len(curve) == 9 and (curve[0].x, curve[8].x, curve[4].y) == (0, 8, 3)


def test_text(spark):
    assert tuple(one(spark, T.count_prefix(F.lit("2xKV1,")))) == (2, "KV1") and tuple(one(spark, T.count_prefix(F.lit("KV1")))) == (1, "KV1")
    assert tuple(one(spark, T.elevation(F.lit("VG-12,30")))) == ("VG", -12300) and one(spark, T.elevation(F.lit("none"))) is None
    assert one(spark, T.number(F.lit("1 234,5"))) == 1234.5 and one(spark, T.number(F.lit("x"))) is None
    assert tuple(one(spark, T.identity(F.lit("KV-X31"), F.lit(None).cast("int")))) == ("KV", "X31", "KV|DN?")


def test_formulas(spark):
    df = spark.createDataFrame([(2.0, None), (0.0, 3.0)], "a double, b double")
    out, errors = formula.with_formulas(df, {"c": "a + b * 2", "d": "c ** 2 if a > 1 else -1", "e": "10 / a", "f": "min(a; b, 1)", "g": "open('x')", "h": "zz", "i": "a ** 99", "j": "if(a; 5; 6)"})
    assert [tuple(r) for r in out.select("c", "d", "e", "f", "j").collect()] == [(2, 4, 5, 0, 5), (6, -1, None, 0, 6)]
    assert set(errors) == {"g", "h", "i"}
    with pytest.raises(formula.FormulaError, match="x, y"):
        formula.order_of({"x": "y + 1", "y": "x + 1"}, set())


def test_choices_keep_ties(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (2, "b")], "k int, v string")
    assert sorted(tuple(r) for r in choose.decided(df, ["k"], "v", F.count("*")).collect()) == [(1, "AMBIGUOUS", None, ["a", "b"]), (2, "CONFIRMED", "a", ["a"])]
    n = spark.range(1000).withColumn("k", F.lit(1))
    assert [r.id for r in choose.thinned(n, ["k"], 9, F.col("id")).orderBy("id").collect()] == [i * 1000 // 9 for i in range(9)]


def test_clamped_fold_equals_a_loop(spark):
    import random

    rng = random.Random(1)
    rows = [(k, i, rng.randint(-9, 9)) for k in range(40) for i in range(rng.randint(1, 30))]
    want = {}
    for k, _, d in rows:
        m, c, n = want.get(k, (0, 0, 0))
        want[k] = (max(0, m + d), c + (m + d < 0), n + 1)
    got = edits.clamped_fold(spark.createDataFrame(rows, "k int, i int, d int"), ["k"], ["i"], "d").collect()
    assert {r.k: (r.metres, r.clamped, r.edits) for r in got} == want


def test_spatial_join_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    box = lambda: (x := rng.randint(0, 99), y := rng.randint(0, 99), x + rng.randint(0, 40), y + rng.randint(0, 5))
    rows = [(i, *box()) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, x0 int, y0 int, x1 int, y1 int")
    for reach in (0, 3):
        want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] - reach <= b[3] and b[1] <= a[3] + reach and a[2] - reach <= b[4] and b[2] <= a[4] + reach)
        got = sorted((r.id, r.r_id) for r in spatial.box_join(df, df, 7, reach=reach).collect())
        assert got == want


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (8, 9), (7, 7)], "a int, b int")
    assert {r.id: r.component for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 7: 7}
    assert {r.id: r.path for r in graph.shortest_paths(e, 1).collect()} == {1: [1], 2: [1, 2], 5: [1, 5], 3: [1, 2, 3], 4: [1, 5, 4]}
    assert [r.id for r in graph.shortest_paths(e, 99).collect()] == [99]
    assert graph.components(e.limit(0)).count() == 0


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 12), (1, 10, 11), (2, 3, 3)], "k int, lo int, hi int")
    assert sorted(tuple(r) for r in interval.union_length(df, ["k"], "lo", "hi").collect()) == [(1, 10, 2), (2, 0, 1)]


def test_tools(spark):
    assert "wrong type" in TOOLS.call(spark, DIR, "pipes", dn="x").first().error
    assert "no tool" in TOOLS.call(spark, DIR, "nothing").first().error
    assert TOOLS.call(spark, DIR, "pipes", system="promo", dn=0).count() > 0
    assert TOOLS.describe(spark).count() == len(TOOLS.known)
    assert TOOLS.call(spark, DIR, "propose_erase", designation="Brand#1", metres=10**9).first().reason == "less than that is there"
