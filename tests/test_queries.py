"""Queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from docloom import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: repr(round(v, 8)) if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, FOLDER)
    got = found.collect()
    if name in queries.SQL:
        cursor = duck.execute(queries.SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(found.columns)
        assert rows(found.columns, got) == rows(names, cursor.fetchall())
    else:
        assert got


def test_entry_points_agree():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
