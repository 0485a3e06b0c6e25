"""Every query of the catalogue against its DuckDB SQL on the smallest driver tables."""

import os

import duckdb
import pandas as pd
import pytest

from dossierlake.plans import catalogue

SF = os.environ.get("DOSSIERLAKE_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        if str(got[c].dtype).startswith("datetime"):
            want[c] = want[c].astype(got[c].dtype)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)
