"""Every query with an oracle gives the oracle's rows."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillstone.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, int, np.floating, np.integer)):
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    return str(v)


def rows(df: pd.DataFrame) -> list:
    return sorted((tuple(map(_plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracles().get(name)
    if sql is None:
        assert len(got.columns)
        return
    expected = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
