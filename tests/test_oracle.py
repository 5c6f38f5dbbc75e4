"""Every registered query against its SQL twin (rows only where SQL has none)."""

import pytest
from oracle import connect, difference

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_matches_known_values(spark):
    got = {r.symbol: (r.profit_factor, r.sharpe) for r in entry(spark).collect()}
    assert got == {
        "1-URGENT": (0.723564, -0.072144),
        "2-HIGH": (0.792070, -0.053806),
        "3-MEDIUM": (0.649239, -0.100102),
        "4-NOT SPECIFIED": (0.533913, -0.132192),
        "5-LOW": (0.558519, -0.136454),
    }


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert difference(df, con, sql) is None
