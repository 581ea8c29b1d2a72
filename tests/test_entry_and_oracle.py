"""Driver contract + oracle agreement on sf0.001 for every query that has SQL."""

import duckdb
import pytest

import __spark_entry__ as E
from risklib.sources.tables import TABLES
from tests.conftest import SF0001

SLOW = {"mod3_tune_logistic", "sel7_rfe_cv", "mod5_stacking", "mod7_tune_all_models"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "fraud_risk_score" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle_agrees_sf0001(spark, con, name):
    from tools.oracle_check import norm, rows_close
    s = E.queries()[name](spark, SF0001).toPandas()
    o = con.sql(E.oracle_sql()[name]).df()
    sc, sr = norm(s)
    oc, orr = norm(o)
    assert sc == oc
    assert len(sr) == len(orr)
    assert all(rows_close(a, b) for a, b in zip(sr, orr))
