"""Driver contract: entry() smoke test and Spark-vs-DuckDB oracle checks."""

import os

import pytest

import __spark_entry__ as E
from conftest import SF001, SF01
from cohortflow.catalog.compare import compare, duck
from cohortflow.catalog.oracle_sql import ORACLE
from cohortflow.catalog.spark_queries import QUERIES

# every library query at the smallest scale; COHORTFLOW_ALL_ORACLES=1 takes the next one
SF = SF01 if os.environ.get("COHORTFLOW_ALL_ORACLES") == "1" else SF001


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "pct" in df.columns and "step_no" in df.columns


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, name):
    r = compare(spark, SF, name, E.queries()[name], E.oracle_sql()[name], duck(SF))
    assert r["status"] == "exact", r
    assert r.get("types") == "ok", r
