"""Every registered query of the mesh library against its SQL."""

import os

import duckdb
import pandas as pd
import pytest

from meshlark import registry

SF = "/root/testdata/sf0.001"
Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda x: "none" if x is None or x is pd.NA or x != x else f"{x:.6g}" if isinstance(x, float) else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, db, name):
    got = Q[name](spark, SF).toPandas()
    assert name in SQL
    want = db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)


def test_imports_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=root, check=True)
