"""Every registered query against its DuckDB oracle on sf0.001 (the driver does the same
at sf0.01); queries without an oracle must at least run."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_harness import compare

QUERIES = E.queries()
ORACLES = E.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck_small, name):
    df = QUERIES[name](spark, SF_SMALL)
    if name not in ORACLES:
        assert df.count() > 0
        return
    res = compare(df, duck_small, ORACLES[name])
    assert res["ok"], res


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
