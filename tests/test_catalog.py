"""Every registered query of the engine's own operators against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tallyloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def comparable(frame):
    def plain(x):
        if x is None or x is pd.NA or x != x:
            return None
        return int(x) if isinstance(x, float) and x == int(x) else round(x, 9) if isinstance(x, float) else x

    columns = sorted(frame.columns)
    return sorted(repr([plain(v) for v in row]) for row in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)
