"""Queries against their SQL in DuckDB, over whole tables."""

import duckdb
import pytest

from quillspark.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    rows = sorted(map(str, map(tuple, got.select(*columns).collect())))
    assert rows == sorted(map(str, want.select(*columns).fetchall())) and len(rows) >= 200
