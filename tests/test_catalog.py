"""Every catalogue query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from rasterloom.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for entry in os.listdir(sf_dir):
        path = f"{sf_dir}/{entry}"
        con.execute(f"create view {entry.split('.')[0]} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_duckdb(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    told = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(told.columns) == columns
    assert plain(map(tuple, df.select(columns).collect())) == plain(told.select(*[f'"{c}"' for c in columns]).fetchall())
