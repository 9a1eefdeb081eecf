"""Every engine query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from thicket.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def _plain(df):
    df = df[sorted(df.columns)]
    return df.loc[df.astype(str).sort_values(list(df.columns)).index].reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, con, name):
    got, want = _plain(catalog.QUERIES[name](spark, SF).toPandas()), _plain(con.execute(catalog.ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-6, atol=2e-6)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
