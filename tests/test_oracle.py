"""Every query of the library against its DuckDB SQL at sf0.001."""

import duckdb
import pandas as pd
import pytest

from lectern.plans.all import ORACLE_SQL, QUERIES
from lectern.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else f"{v:.6g}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in ORACLE_SQL:
        pd.testing.assert_frame_equal(plain(got), plain(duck.execute(ORACLE_SQL[name]).df()))
