"""Every query of the catalogue runs on the smallest tables and agrees with its SQL where it has one."""

import glob
import os

import duckdb
import pytest

from factloom.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()

#: Queries that SQL can't express, with the reason.
WITHOUT_SQL: dict[str, str] = {}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i] + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert name in SQL or name in WITHOUT_SQL, f"{name} has no SQL, and no reason is given"
    if name not in SQL:
        assert len(rows) > 0
        return
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(rows, df.columns) == canonical(cursor.fetchall(), columns)


def test_sql_names_queries():
    assert set(SQL) <= set(QUERIES) and set(WITHOUT_SQL) == set(QUERIES) - set(SQL)
