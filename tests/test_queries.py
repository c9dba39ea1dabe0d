"""Every registered query with SQL, against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from conftest import SF

from framelake.plans import catalogue


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("lineitem", "orders", "events", "embeddings"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name not in catalogue.ORACLES:
        return
    want = duck.execute(catalogue.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [c for c in columns if not pd.api.types.is_float_dtype(got[c])] or columns
    got, want = (x[columns].sort_values(order + [c for c in columns if c not in order]).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        if pd.api.types.is_float_dtype(got[c]) or pd.api.types.is_float_dtype(want[c]):
            pd.testing.assert_series_equal(got[c].astype(float), want[c].astype(float), check_exact=False, atol=2e-6, rtol=1e-9)
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist()
