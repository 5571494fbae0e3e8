"""Every catalogue query against its SQL twin in DuckDB."""

import math

import duckdb
import pytest

from quillspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in catalogue.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    def value(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)):
            return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.3f}"
        return str(v)

    return sorted(tuple(value(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_same_rows(spark, db, name):
    got = catalogue.queries()[name](spark, SF)
    want = db.sql(catalogue.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = got.select(*[f"`{c}`" for c in columns]).collect()
    assert plain(rows) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())
