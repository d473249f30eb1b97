"""Every query with SQL equals DuckDB on the smallest tables; the others run and give rows."""

import duckdb
import pandas as pd
import pytest

from quillstone.plans import catalog
from quillstone.session import TABLES

DATA = "/root/testdata/sf0.001"
#: Queries that may rightly be empty on the smallest tables.
EMPTY = {"noise_report"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]) and df[c].dtype != bool:
            df[c] = df[c].astype(float).round(6)
    df = df.astype(object).where(df.notna(), None).map(repr)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, duck):
    got = catalog.queries()[name](spark, DATA).toPandas()
    assert len(got) or name in EMPTY
    sql = catalog.oracle_sql().get(name)
    if sql:
        pd.testing.assert_frame_equal(plain(got), plain(duck.sql(sql).df()))
