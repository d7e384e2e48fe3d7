"""Every registered query beside its oracle text, on the smallest test folder."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of
from hirelake.catalog.bindings import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Trained or iterated long: run by check.py.
SLOW = {"train_family_head", "score_family", "requirements"}


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_matches_its_oracle(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    columns, got = rows_of(df.columns, df.collect())
    if name in ORACLES:
        cur = oracle.execute(ORACLES[name])
        wanted_columns, wanted = rows_of([d[0] for d in cur.description], cur.fetchall())
        assert columns == wanted_columns
        assert got == wanted


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
