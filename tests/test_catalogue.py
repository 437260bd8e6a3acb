"""Every query against its SQL at the smallest scale."""

import glob
import os

import duckdb
import pytest

from quayline.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return db


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_matches_sql(spark, con, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    want = con.execute(catalogue.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(map(repr, t[columns].astype(str).values.tolist())) for t in (got, want)]
    assert rows[0] == rows[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 40
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
