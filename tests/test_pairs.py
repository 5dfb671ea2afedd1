"""Queries over crowded places: the rows that joins make stay in proportion to tables and results, and the results are the SQL's."""

import random

import duckdb
import pytest

from plumbline import registry
from plumbline.operators import spatial
from tests.test_queries import norm


def made(df):
    """Rows of df, and how many rows its largest join made."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        got = p.metrics().get("numOutputRows")
        if "Join" in name and got.isDefined():
            most = max(most, got.get().value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows, most


def tables(spark, tmp_path, **rows):
    """A folder of the tables, rows being (schema, rows), and a connection that has them as views."""
    con = duckdb.connect()
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return str(tmp_path), con


def held(spark, folder, con, name):
    """Holds a query against its SQL; (rows, most rows of a join)."""
    rows, most = made(registry.queries()[name](spark, folder))
    want = con.sql(registry.oracles()[name])
    cols = sorted(want.columns)
    key = lambda rows: sorted(repr([norm(r[c]) for c in cols]) for r in rows)
    assert key(rows) == key(dict(zip(want.columns, r)) for r in want.fetchall())
    return len(rows), most


PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def parts(n, seed, sizes=50, types=2, step=1):
    rng = random.Random(seed)
    names = ["red bolt", "blue bolt", "red ring", "ring", "tin  cap"]
    return [(k * step, rng.choice(names), f"Brand#{rng.randint(1, 5)}", f"T{rng.randrange(types)}", rng.randint(1, sizes), float(rng.randint(1, 40))) for k in range(1, n + 1)]


def test_article_match_of_many_articles_of_a_kind(spark, tmp_path):
    odd = [(9001, None, "b", "T0", 2, 1.0), (9002, "red bolt", "b", None, 2, 1.0), (9003, "red bolt", "b", "T0", None, 1.0), (9004, "red ring", "b", "T1", 3, None), (9005, "solo", "b", "T9", 3, None)]
    folder, con = tables(spark, tmp_path, part=(PART, parts(1500, 1, sizes=4) + parts(5, 1, sizes=4) + odd))
    rows, most = held(spark, folder, con, "article_match")
    assert most <= 2 * rows


LINEITEM = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string"


def crossing_lines(n, seed):
    rng = random.Random(seed)
    return [(900 * rng.randint(0, 40) + rng.randint(0, 8), 400 * rng.randint(0, 3) + rng.randint(0, 30), rng.randint(1, 5), i % 7, float(rng.randint(0, 50)), "A") for i in range(n)]


def test_contact_tiers_where_many_leaders_stand_at_one_place(spark, tmp_path):
    some = parts(300, 2, step=1200) + parts(10, 2) + parts(3, 2, step=1200) + [(None, "n", "b", "t", 1, 1.0)]
    folder, con = tables(spark, tmp_path, part=(PART, some), lineitem=(LINEITEM, crossing_lines(400, 3) + [(2, None, 1, 1, 3.0, "A")]))
    rows, most = held(spark, folder, con, "contact_tiers")
    assert rows >= 300 and most <= 1000


def test_inside_hatch_counts_without_pairs(spark, tmp_path):
    some = parts(40, 2, step=3600) + parts(200, 2) + parts(3, 2) + [(None, "n", "b", "t", 1, 1.0)]
    folder, con = tables(spark, tmp_path, part=(PART, some), lineitem=(LINEITEM, crossing_lines(2000, 4) + [(2, 3, 1, 1, -9.0, "A"), (2, None, 1, 1, 3.0, "A")]))
    rows, most = held(spark, folder, con, "inside_hatch")
    assert rows > 40 and most <= 300


@pytest.mark.parametrize("name", ["mutual_nearest", "uncontested_claims"])
def test_nearest_of_many_ends_at_one_place(spark, tmp_path, name):
    some = parts(600, 8, step=997) + parts(300, 9) + parts(20, 10, step=41) + [(7, "n", "b", None, 1, 1.0), (None, "n", "b", "T0", 1, 1.0)]
    folder, con = tables(spark, tmp_path, part=(PART, some))
    rows, most = held(spark, folder, con, name)
    assert most <= 8000


def test_nearest_anchor_of_many_anchors_at_one_place(spark, tmp_path):
    some = [(p[0] + 50, *p[1:]) for p in parts(60, 11, step=1500)] + parts(50, 12) + parts(5, 13) + [(9, "n", "b", "t", None, 1.0)]
    suppliers = [(k,) for k in [*range(1, 40), 650, 2150, *range(1204, 1500 * 400, 1500), 3, None]]  # two on the sixty labels, and 400 within their reach
    folder, con = tables(spark, tmp_path, part=(PART, some), supplier=("s_suppkey bigint", suppliers))
    rows, most = held(spark, folder, con, "nearest_anchor")
    assert most <= rows


def test_clashes_compare_each_box_once(spark, tmp_path, monkeypatch):
    def once(left, *rest, **more):
        assert left.count() == left.select("x0", "y0", "z0", "x1", "y1", "z1").distinct().count()
        return join(left, *rest, **more)

    join = spatial.box_join
    monkeypatch.setattr(spatial, "box_join", once)
    some = parts(600, 5, sizes=2, step=300) + parts(200, 6) + parts(3, 7) + [(7, "n", "b", None, 1, 1.0), (8, "n", None, "t", 1, 1.0), (9, "n", "b", "t", None, 1.0)]
    folder, con = tables(spark, tmp_path, part=(PART, some))
    rows, most = held(spark, folder, con, "clashes")
    assert most <= 1.6 * rows
