"""Every query of the library with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from plumbline import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    want = duck.sql(registry.oracles()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    key = lambda rows: sorted(repr([norm(r[c]) for c in cols]) for r in rows)
    assert key(r.asDict(recursive=True) for r in df.collect()) == key(dict(zip(want.columns, r)) for r in want.fetchall())


#: Fixpoints and walks that SQL does not say: their operators are held against plain versions in the other tests.
WITHOUT_SQL = {"propagated_names", "pipe_frontiers", "paired_runs", "discovered_leaders", "leader_claims", "riser_marks", "read_designations"}


def test_every_other_query_has_sql():
    assert set(registry.queries()) - set(registry.oracles()) == WITHOUT_SQL
