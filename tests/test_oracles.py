"""Every registered query against its SQL text, on the smallest given tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, compare

SF = "/root/testdata/sf0.001"
SLOW = {"ml_grid"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    msg, _ = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert msg is None, msg


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.columns and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
