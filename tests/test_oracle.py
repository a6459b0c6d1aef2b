"""Every SQL-checkable query: Spark result == DuckDB oracle on sf0.01
(row count, column names, order-insensitive value hash)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import canon, duck  # noqa: E402
from places import SF01  # noqa: E402

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF01).toPandas()
    want = con.execute(SQL[name]).df()
    assert canon(got) == canon(want)


def test_every_query_has_a_callable():
    qs = E.queries()
    assert set(SQL) <= set(qs)
    assert len(qs) >= 50


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["doc_id", "split", "label"]
