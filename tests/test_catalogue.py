"""Each query against its oracle, on the small tables."""

import os

import duckdb
import pytest

from lexspark.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f[:-8]} as select * from '{DIR}/{f}'")
    return c


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple("" if v is None or v != v else str(float(v)) if hasattr(v, "__float__") and not isinstance(v, str) else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name in ORACLES:
        assert _rows(got) == _rows(con.sql(ORACLES[name]).df())
    else:
        assert len(got) > 0
