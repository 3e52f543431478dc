"""Every registered query of the engine's own operators against its SQL."""

import duckdb
import pandas as pd
import pytest

from quire.plans.queries import QUERIES, SQL
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()

    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return repr(round(float(v), 6))
        return str(v)

    for c in df.columns:
        df[c] = df[c].map(one)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def oracle(sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.execute(sql).df()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got, want = norm(QUERIES[name](spark, SF).toPandas()), norm(oracle(SQL[name]))
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want)


def test_group_lines_keeps_pages(spark):
    assert QUERIES["group_lines"](spark, SF).count() > 0
