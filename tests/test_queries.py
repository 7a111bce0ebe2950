"""Every registered query against its DuckDB SQL on the smallest tables; the others must run."""

import os

import duckdb
import pytest

from graphmill.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]").astype("int64")
        elif df[c].dtype.kind in "fiub":
            df[c] = df[c].astype(float).round(5)
        else:
            df[c] = df[c].map(lambda x: None if x is None or x != x else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = norm(QUERIES[name](spark, SF).toPandas())
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = norm(con.execute(ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["src_module", "dst_module", "weight", "flags"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
