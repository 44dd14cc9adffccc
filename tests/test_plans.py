"""Physical-plan checks: pushdown and pruning reach the event scan; no query
uses a cartesian product, a nested-loop join or a Python UDF."""

import os
import re

import pytest

import __spark_entry__ as E
from conftest import SF001

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "PythonUDF")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# every query with COHORTFLOW_ALL_PLANS=1; a cross-section of operator groups otherwise
SUBSET = ["players_cohort", "funnel_cube_pct", "retention_cube", "ba_significance",
          "ba_retention", "coverage", "install_summary", "alerts_installs", "alerts_trend",
          "alerts_retention"]


@pytest.mark.parametrize("name", sorted(E.queries()) if os.environ.get("COHORTFLOW_ALL_PLANS")
                         == "1" else SUBSET)
def test_no_forbidden_operators(spark, name):
    plan = _plan(E.queries()[name](spark, SF001))
    for op in FORBIDDEN:
        assert op not in plan, (name, op)


def test_event_scan_pushdown_and_pruning(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = _plan(E.queries()["funnel_cube_pct"](spark, SF001))
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "events.parquet" in line]
    assert scans
    for s in scans:
        schema = re.search(r"ReadSchema: struct<([^>]*)>", s).group(1)
        assert "value" not in schema and "event_id" not in schema       # pruned columns
    pushed = " ".join(scans)
    assert "GreaterThanOrEqual(ts," in pushed and "LessThan(ts," in pushed   # date band
    assert "In(event_type," in pushed                                        # spec event names


def test_published_cube_read_prunes_partitions(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = _plan(E.queries()["cube_load"](spark, SF001))
    scan = [line for line in plan.split("\n") if "FileScan parquet" in line][0]
    assert "PartitionFilters: [isnotnull(install_date" in scan and "install_date#" in scan
    assert "PushedFilters: [IsNotNull(platform), Not(EqualTo(platform,none))" in scan


def test_strict_72h_waits_for_full_window(spark):
    from datetime import date
    from cohortflow.config import EngineConfig
    from cohortflow.operators.funnel import build_funnel_72h
    from cohortflow.plans.steps import demo_funnel
    from cohortflow.sources import TestdataSource
    cfg = EngineConfig.for_testdata()
    b = build_funnel_72h(TestdataSource(spark, SF001), cfg, demo_funnel(), strict=True)
    latest = b.cohort.agg({"install_date": "max"}).first()[0]
    assert latest <= date(2024, 1, 26)          # as_of - 1 - 3 days


def test_raw_events_are_aggregated_before_any_exchange(spark):
    """With broadcasts off: no exchange carries raw events in the first pass,
    and the anchors run on hash aggregates."""
    from cohortflow.config import EngineConfig
    from cohortflow.operators.funnel import build_funnel
    from cohortflow.plans.steps import main_funnel
    from cohortflow.sources import TestdataSource
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        b = build_funnel(TestdataSource(spark, SF001), EngineConfig.for_testdata(), main_funnel(),
                         materialize=False)
        lines = _plan(b.anchors).split("\n")
    finally:
        spark.conf.set(key, old)
    scans = [i for i, line in enumerate(lines) if "FileScan parquet" in line and "events.parquet" in line]
    assert scans
    for i in scans:
        above = []
        while i >= 0 and "Exchange" not in lines[i]:
            above.append(lines[i])
            i -= 1
        assert any("Aggregate" in line for line in above), above
    first = next(line for line in lines if "count(1)" in line)
    assert "HashAggregate" in first and "SortAggregate" not in first
