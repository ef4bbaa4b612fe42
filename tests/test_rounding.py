"""Rounded predictions near halves against DuckDB."""

import duckdb
import pytest

from featuremill import plans


@pytest.mark.parametrize("name", ["ml19_prediction_report", "j09_compared", "j05_stacked_predictions"])
def test_predictions_near_halves(spark, tmp_path, name):
    """Balances whose prediction is a half of a hundredth but for the last bits of a double."""
    c = duckdb.connect()
    rows = "SELECT 25 * k + n AS c_custkey, n::INT AS c_nationkey, (4500 + 100 * k)::DOUBLE AS c_acctbal FROM range(-54, 55) a(k), range(0, 25) b(n)"
    c.execute(f"COPY ({rows}) TO '{tmp_path}/customer.parquet'")
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    out = c.sql(plans.SQL[name])
    got = plans.QUERIES[name](spark, str(tmp_path)).select(out.columns).collect()
    assert len(got) == 109 * 25
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, out.fetchall()))
