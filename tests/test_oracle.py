"""Every registered query equals its DuckDB oracle (the driver's gate), at sf0.01."""

import pytest

import __spark_entry__ as E
from conftest import SF_ORACLE
from strike_analytics.plans.registry import ORACLE_SQL
from tools.check_oracle import _rows, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_ORACLE)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    res = con.execute(E.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    want = _rows(res.fetchall(), cols)
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(want)
    assert got == want


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 23
    assert all(r.distance_km <= 500 for r in rows)
