"""Every catalogued query against its DuckDB twin on the smallest tables."""

import duckdb
import pytest

from weftline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool) or not isinstance(value, int | float):
        return str(value)
    return f"{float(value):.6f}"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    rows = sorted(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    if name not in catalog.oracles():
        assert rows
        return
    want = duck.sql(catalog.oracles()[name])
    order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    assert sorted(want.columns) == sorted(got.columns)
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
