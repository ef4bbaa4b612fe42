"""Every query that has SQL against DuckDB on the smallest tables; the others run."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from featuremill import plans

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in plans.SQL:
        assert rows
        return
    out = duck.sql(plans.SQL[name])
    columns = sorted(out.columns)
    assert sorted(df.columns) == columns
    place = [out.columns.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in place)) for r in out.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in rows) == want
