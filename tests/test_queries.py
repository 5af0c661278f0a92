"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from chronolake.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float):
        return round(float(v), 6)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SMALL)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got.count() >= 0
        return
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", ["bin_hourly_sparse", "bin_clip_to_end"])
def test_binning_joins_on_the_person_alone(spark, name):
    plan = catalogue.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_entry():
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables")
def test_whole_tables_have_queries(spark, duck):
    """Spans, cohort, gaps and pivots also run on all users, rows, variables and days."""
    q = catalogue.queries()
    users = duck.execute("SELECT count(DISTINCT user_id) FROM events WHERE user_id IN (SELECT c_custkey FROM customer)").fetchone()[0]
    kinds = duck.execute("SELECT count(DISTINCT event_type) FROM events").fetchone()[0]
    assert q["obs_cohort_all"](spark, SMALL).count() == users > q["obs_cohort"](spark, SMALL).count()
    assert q["extract_spans_all"](spark, SMALL).count() == users * kinds * 8
    assert len(q["long_to_wide_all"](spark, SMALL).columns) == 1 + kinds * 10
