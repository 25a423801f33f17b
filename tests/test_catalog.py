"""Each query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sigframe.plans import catalog

TABLES = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in NAMES:
        connection.sql(f"create view {t} as select * from '{TABLES}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, TABLES).toPandas()
    want = duck.sql(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    assert [str(t) for t in got.dtypes] == [str(t) for t in want.dtypes]
    assert all((got[c] == want[c]).all() for c in columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 62
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_map_fft(spark):
    import numpy as np

    x = np.array([r.v for r in catalog.vectors(spark, TABLES).df.orderBy("idx").collect()])
    want = np.abs(np.fft.rfft(x, axis=1)[:, :4]) ** 2
    got = np.zeros_like(want)
    for r in catalog.QUERIES["map_fft"](spark, TABLES).collect():
        got[r.idx, r.k] = r.p
    assert np.allclose(got, want, atol=1e-5)
