"""The queries that SQL can express, against it."""

import os

import duckdb
import pandas as pd
import pytest

from meshlark.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    db = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = db.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    order = ["doc_id"]
    pd.testing.assert_frame_equal(got[sorted(got)].sort_values(order).reset_index(drop=True), want[sorted(want)].sort_values(order).reset_index(drop=True), check_dtype=False, check_exact=True)
