"""Every query against its SQL, on the smallest tables."""

import os

import pytest

from sparkloom import file_queries, queries  # noqa: F401

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return c


def canonical(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = db.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_flagship(spark):
    assert queries.flagship(spark, SF).count() > 0
