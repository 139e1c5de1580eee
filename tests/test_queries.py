"""Every registered journey query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from wayfarer import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def normal(frame):
    def cell(v):
        if v is None or v != v:
            return "NULL"
        return repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(cell, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, duck, name):
    found = plans.QUERIES[name](spark, sf).toPandas()
    if name in plans.ORACLE_SQL:
        assert normal(found) == normal(duck.execute(plans.ORACLE_SQL[name]).df())
    else:
        assert len(found)


def test_entry(spark):
    assert entry.entry(spark).columns == ["route", "nodes", "journeys"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
