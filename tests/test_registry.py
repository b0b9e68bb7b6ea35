import duckdb
import pytest

import __spark_entry__ as entry
from strandmill.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda x: sorted(map(tuple, x[sorted(a.columns)].astype(object).where(x[sorted(a.columns)].notna(), None).values.tolist()), key=repr)
    return rows(a) == rows(b)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, small, name):
    assert same(registry.QUERIES[name](spark, small).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_run(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["q_id", "name", "qlen", "ref", "fwd", "pos", "support"]
