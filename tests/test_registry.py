"""Every registered query against its SQL, over the smallest given tables."""

import os

import duckdb
import pandas as pd
import pytest

from leafmill.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(pdf):
    cols = sorted(pdf.columns)
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind in "iufb" or isinstance(v, int) else str(v)
    return cols, sorted((tuple(map(plain, r)) for r in pdf[cols].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    if name in registry.oracle_sql():
        assert rows(got) == rows(duck.sql(registry.oracle_sql()[name]).df())
    else:
        assert len(got.columns)
