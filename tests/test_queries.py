"""Every registered query against its SQL twin on the smallest tables, as the driver does on larger ones."""

import numbers
import os

import pandas as pd
import pytest

from strataq.plans import catalogue
from strataq.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_flagship_is_registered():
    assert catalogue.FLAGSHIP in QUERIES


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return None
    return float(v) if isinstance(v, numbers.Number) else str(v)


def rows(df, columns):
    return sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
