"""Every registered core query runs on the smallest tables and agrees with its SQL."""

import glob
import os

import duckdb
import pytest

from locuslake.plans import core_queries


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def norm(v):
    return repr(round(v, 6) if isinstance(v, float) else list(v) if isinstance(v, (list, tuple)) else v)


@pytest.mark.parametrize("name", sorted(core_queries.Q))
def test_query(spark, sf, con, name):
    df = core_queries.Q[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name in core_queries.SQL:
        r = con.sql(core_queries.SQL[name])
        assert sorted(r.columns) == cols
        at = [r.columns.index(c) for c in cols]
        assert got == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())
    else:
        assert got
