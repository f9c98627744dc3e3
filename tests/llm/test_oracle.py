"""The queries that SQL can express, against their SQL."""

import duckdb
import pytest

from ledgerline.llm.oracle import SQL
from ledgerline.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    found = con.execute(SQL[name])
    columns = [c[0] for c in found.description]
    got = QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, found.fetchall()))
