"""Every registered query with SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

from foliospark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    got = sorted((tuple(map(plain, r)) for r in frame.select(*[f"`{c}`" for c in columns]).collect()), key=key)
    if name not in catalog.SQL:
        assert got
        return
    rows = duck.sql(catalog.SQL[name])
    assert sorted(rows.columns) == columns
    order = [rows.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in rows.fetchall()), key=key)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
