"""Every registered query of the engine against its DuckDB SQL."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from loomkv import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = Q.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(*cols).collect())
    rel = duck.sql(Q.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = sorted(map(repr, duck.sql(f"SELECT {quoted} FROM ({Q.oracle_sql()[name]})").fetchall()))
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["anti_entropy_sync", "anti_entropy_rounds"])
def test_sibling_sets_are_derived_once(spark, monkeypatch, name):
    """Whatever a round reads twice is read from a written table, not derived from the events again."""
    from loomkv.streaming import folders

    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    real = folders.written
    monkeypatch.setattr(folders, "written", lambda df: plan(df) or real(df))
    plan(Q.queries()[name](spark, SF))
    assert sum(p.count("Relation [event_id") for p in plans) == 1
