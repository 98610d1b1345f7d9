"""Every registered query against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from rolesift.plans import oracle, registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES = registry.QUERIES
SQL = oracle.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(driver.queries())
    assert set(SQL) <= set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    relation = duck.sql(SQL[name])
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    order = [relation.columns.index(n) for n in names]
    expected = [tuple(r[i] for i in order) for r in relation.fetchall()]
    got = [tuple(r) for r in df.select(*names).collect()]
    assert got, "an empty result checks nothing"
    assert len(got) == len(expected)
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_review_order(spark):
    got = QUERIES["review_list"](spark, SF_DIR).collect()
    keys = [(-r.score, r.posting_id) for r in got]
    assert keys == sorted(keys)
    assert QUERIES["review_top"](spark, SF_DIR).collect() == got[:100]
