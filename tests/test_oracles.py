"""Every registered datasheet query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from sheetloom.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DIR}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    want = duck.execute(ORACLES[name]).to_arrow_table()
    got = QUERIES[name](spark, DIR)
    cols = sorted(want.column_names)
    assert cols == sorted(got.columns)
    rows = lambda t: sorted(repr(tuple(r.values())) for r in t.select(cols).to_pylist())
    assert rows(got.select(*[f"`{c}`" for c in cols]).toArrow()) == rows(want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
