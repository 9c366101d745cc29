"""The registered SQL says what the operators do."""

import duckdb
import pytest

from loamstone.llm import queries

from ..test_oracles import TABLES, plain


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, data, name):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    assert plain(queries.queries()[name](spark, data).toPandas()) == plain(connection.sql(queries.oracle_sql()[name]).df())
