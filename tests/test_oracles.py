"""Every registered query that SQL can express gives what DuckDB gives."""

import math

import duckdb
import pytest

from loamstone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame):
    columns = sorted(frame.columns)
    cell = lambda x: "null" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{float(x):.6f}" if hasattr(x, "dtype") and x.dtype.kind == "f" or isinstance(x, float) else str(x)
    return columns, sorted(tuple(map(cell, row)) for row in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, duck, name):
    got = registry.queries()[name](spark, data).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    assert plain(got) == plain(duck.sql(sql).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
