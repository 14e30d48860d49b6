"""Every catalogue query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from corpuslens.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (float, int)) and not isinstance(v, bool):
        return repr(float(v))
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue()))
def test_query(spark, con, name):
    run, sql = catalogue()[name]
    got = run(spark, SF)
    rows = [[plain(r[c]) for c in sorted(got.columns)] for r in got.collect()]
    if not sql:
        assert rows
        return
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(got.columns) == sorted(names)
    assert sorted(rows) == sorted([plain(r[i]) for i in order] for r in want.fetchall())
