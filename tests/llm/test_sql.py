"""The queries of the operators that SQL can express have the rows that DuckDB gives."""

import duckdb
import pytest

from test_queries import TABLES, rows
from vexil.llm import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got, want = queries.queries()[name](spark, sf_dir).toArrow(), duck.execute(queries.oracle_sql()[name]).to_arrow_table()
    assert want.num_rows > 0 and sorted(got.column_names) == sorted(want.column_names) and rows(got) == rows(want)
