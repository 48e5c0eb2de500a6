"""Every query with SQL against DuckDB on the same tables."""

import os

import pandas as pd
import pytest

from aerolake.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Where a query finds nothing in SF: archives of years need more hours.
LARGER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    out = {}
    for folder in (SF, LARGER):
        con = duckdb.connect()
        con.sql("SET TimeZone = 'UTC'")
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        out[folder] = con
    return out


def rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    sql = registry.oracle_sql()[name]
    folder, want = SF, duck[SF].sql(sql).df()
    if not len(want):
        folder, want = LARGER, duck[LARGER].sql(sql).df()
    assert len(want)  # nothing compared with nothing tells nothing
    got = registry.queries()[name](spark, folder).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        if pd.api.types.is_integer_dtype(want[c]) and got[c].isna().sum() == 0:
            want[c], got[c] = want[c].astype("int64"), got[c].astype("int64")
        if pd.api.types.is_datetime64_any_dtype(want[c]) or str(want[c].dtype) == "object" and "date" in str(type(got[c].iloc[0] if len(got) else "")):
            want[c], got[c] = pd.to_datetime(want[c]).astype("datetime64[us]"), pd.to_datetime(got[c]).astype("datetime64[us]")
        if pd.api.types.is_float_dtype(want[c]) or pd.api.types.is_float_dtype(got[c]):
            want[c], got[c] = want[c].astype(float).round(6), got[c].astype(float).round(6)
    pd.testing.assert_frame_equal(rows(got), rows(want))


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
