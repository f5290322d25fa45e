"""Driver contract: entry() runs, every query returns a DataFrame, and every
oracle matches its Spark query on the smallest test tables (the same
comparison the driver makes at sf0.01)."""

import os

import pytest

import __spark_entry__ as entry_mod
from conftest import SMOKE

HAVE_DATA = os.path.isdir(SMOKE)


@pytest.mark.skipif(not HAVE_DATA, reason="driver test data not present")
def test_entry(spark):
    df = entry_mod.entry(spark)
    assert "query_id" in df.columns and df.count() >= 0


def test_keys_match():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40


@pytest.mark.skipif(not HAVE_DATA, reason="driver test data not present")
def test_oracles_sf0001(spark):
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    from check_oracle import compare, duck
    con = duck(SMOKE)
    bad = []
    for name, fn in entry_mod.queries().items():
        sql = entry_mod.oracle_sql().get(name)
        if not compare(spark, con, name, fn, sql, SMOKE, verbose=False):
            bad.append(name)
    assert bad == []
