"""Every registered panel query against its SQL twin in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from panelia.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def same(a, b) -> bool:
    if a is None or b is None or a != a or b != b:
        return (a is None or a != a) and (b is None or b != b)
    return a == b or isinstance(a, float) and abs(a - b) <= 2e-6 * max(1.0, abs(a))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name not in catalogue.SQL:
        assert rows is not None
        return
    found = duck.sql(catalogue.SQL[name])
    assert sorted(found.columns) == sorted(df.columns)
    at = [found.columns.index(c) for c in sorted(found.columns)]
    want = [tuple(r[i] for i in at) for r in found.fetchall()]
    assert len(rows) == len(want)
    key = lambda r: tuple("" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x) for x in r)
    for x, y in zip(sorted(rows, key=key), sorted(want, key=key)):
        assert all(same(p, q) for p, q in zip(x, y)), (x, y)
